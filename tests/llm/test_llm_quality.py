import random
from collections import Counter

import numpy as np
import pytest
from llm_data import docs, no_docs, prose, rows

from foldstream.llm import quality
from foldstream.llm.quality import RepeatRules, SuffixArray, covered, keep_good, measure


def plain(words, least):
    """Words under 8-word windows found twice, words under repeats of `least` or more, longest repeat."""
    n = len(words)
    windows = Counter(tuple(words[i:i + 8]) for i in range(n - 7))
    first, under, longest = set(), set(), 0
    for i in range(n - 7):
        if windows[tuple(words[i:i + 8])] > 1:
            first.update(range(i, i + 8))
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        if best >= least:
            under.update(range(i, i + best))
            longest = max(longest, best)
    return len(first), len(under), longest


def test_counts_match_brute_force():
    rng = random.Random(1)
    texts = []
    for _ in range(150):
        kinds = rng.choice([1, 2, 3, 40])
        texts.append([b"w%d" % rng.randrange(kinds) for _ in range(rng.randrange(60))])
    found = measure([b" ".join(t) for t in texts], RepeatRules(min_repeat=9))
    for words, got in zip(texts, found):
        assert plain(words, 9) == (got["n_repeat_words"], got["covered_words"], got["longest_repeat"])
        assert got["n_words"] == len(words)


def test_maximal_repeats_have_no_extension():
    import numpy as np

    rng = random.Random(3)
    for _ in range(30):
        words = np.array([rng.randrange(2) for _ in range(40)])
        array = SuffixArray(words, np.zeros(40, int), least=1)
        found = dict()
        for length, at in array.maximal_repeats(2):
            found[tuple(words[at[0]:at[0] + length])] = at
        text = words.tolist()
        expected = {}
        for length in range(2, 40):
            places = {}
            for i in range(40 - length + 1):
                places.setdefault(tuple(text[i:i + length]), []).append(i)
            for key, at in places.items():
                left = {text[i - 1] if i else f"start{i}" for i in at}
                right = {text[i + length] if i + length < 40 else f"end{i}" for i in at}
                if len(at) > 1 and len(left) > 1 and len(right) > 1:
                    expected[key] = at
        assert found == expected


def test_verdicts():
    block = prose(200, 5).encode()
    verdicts = [m["kept"] for m in measure([
        prose(300, 2).encode(),  # clean
        b"one two three",  # short
        block + b" " + prose(1200, 6).encode() + b" " + block,  # a long passage twice
        b"spam eggs " * 100,
    ])]
    assert verdicts == [True, False, False, False]


def test_base_counts():
    text = "a# b\nsame line\n\nsame line\n \nÉté$\n".encode()
    got = measure([text])[0]
    assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"]) == (7, 23, 2, 1)


def test_awkward_rows(spark):
    kept = keep_good(docs(spark)).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 1, 1, 2, 7, 8]
    assert keep_good(docs(spark)).columns == docs(spark).columns
    assert keep_good(no_docs(spark)).count() == 0
    by_id = {r["doc_id"]: r["_quality"] for r in quality.assess(docs(spark)).collect()}
    assert by_id[3]["n_words"] == by_id[4]["n_words"] == by_id[5]["n_words"] == 0 and by_id[3]["base_failed"]
    assert by_id[8]["n_words"] == 30_000
    assert len(rows()) == quality.assess(docs(spark)).count()


def test_short_repeats_are_refused():
    with pytest.raises(ValueError):
        measure([b"x"], RepeatRules(min_repeat=2))


def test_neighbour_prefixes_cover_what_the_maximal_repeats_do():
    rng = np.random.default_rng(8)
    for _ in range(20):
        part = rng.integers(0, 50, 25)
        words = np.concatenate([x for _ in range(6) for x in (part[rng.integers(0, 9):], rng.integers(0, 50, rng.integers(0, 9)))]).astype(np.int64)
        array = SuffixArray(words, np.zeros(len(words), np.int64))
        longest = array.longest_here()
        starts = np.nonzero(longest >= 8)[0]
        found = array.maximal_repeats(8)
        spans = [(at, length) for length, places in found for at in places]
        by_walk = covered(len(words), np.array([a for a, _ in spans], int), np.array([n for _, n in spans], int))
        assert np.array_equal(covered(len(words), starts, longest[starts]), by_walk)
        assert longest.max(initial=0) == max((n for n, _ in found), default=0)
