import random

import numpy as np
import xxhash
from llm_data import docs, no_docs, prose

from foldstream.llm.components import component_of
from foldstream.llm.simhash import fingerprint, keep_one, keep_one_alike, links, near_duplicates, trie_links


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(values, budget=2):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints():
    for text in ["", " \n", "One", "One two", "one TWO three", "a b c d é f " * 30, "É é A a"]:
        assert fingerprint(text.encode()) == plain_fingerprint(text), text


def test_trie_matches_all_pairs():
    rng = np.random.default_rng(0)
    for _ in range(10):
        values = rng.integers(0, 2**63, 3, dtype=np.uint64)[rng.integers(0, 3, 150)]
        for _ in range(rng.integers(1, 8)):
            values = values ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64))
        values = np.unique(values)
        assert trie_links(values, None, 0, 0).tolist() == plain_groups(values.tolist())


def test_nodes_that_are_split_again(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(2)]
    values = {0, 1, 2**64 - 1, 2**64 - 2}
    for _ in range(250):
        v = rng.choice(base)
        for _ in range(6):
            v ^= 1 << rng.randrange(24, 64)
        values.add(v)
    values = sorted(values)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "_fp long")
    label = {r["node"]: r["root"] for r in component_of(links(df, node_rows=8)).collect()}
    found, expected = [label.get(v, v) for v in signed], plain_groups(values)
    assert len(set(zip(found, expected))) == len(set(found)) == len(set(expected))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(5, 5), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in component_of(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130)) and got[201] == 200
    assert component_of(spark.createDataFrame([], "u long, v long")).count() == 0


def test_awkward_rows(spark):
    found = near_duplicates(docs(spark)).collect()
    assert len(found) == 11
    group = {r["doc_id"]: r["component_id"] for r in found}
    assert group[1] == group[2] == 1 and group[3] == group[4] == group[5] == 3 and group[8] == 8
    kept = keep_one(docs(spark))
    assert kept.columns == docs(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 3 in ids and 4 not in ids and 8 in ids
    assert near_duplicates(no_docs(spark)).count() == 0 and keep_one(no_docs(spark)).count() == 0


def test_near_copies_of_known_similarity(spark):
    """Against all pairs, with copies on both sides of 0.8, a large group of near copies, and one that hangs on a chain."""
    def grams(text):
        w = text.lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}

    texts, rng = [], random.Random(4)
    for base in range(12):
        words = prose(120, 900 + base).split()
        texts.append(" ".join(words))
        for changes in (1, 2, 3, 4):
            texts.append(" ".join("zz%d" % rng.randrange(10**6) if i in rng.sample(range(120), changes) else w for i, w in enumerate(words)))
            other = list(words)
            for i in rng.sample(range(120), changes):
                other[i] = "yy%d" % rng.randrange(10**6)
            texts.append(" ".join(other))
    hot = prose(150, 77).split()
    for i in range(90):
        texts.append(" ".join([*hot[:i], "qq%d" % i, *hot[i + 1:]]))
    texts += [texts[0], texts[5], "", "too few words"]
    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = 0
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                near += bin(fingerprint(texts[i].encode()) ^ fingerprint(texts[j].encode())).count("1") > 2
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = sorted({find(i) for i in range(len(texts))})
    assert near > 20 and sorted(r["doc_id"] for r in keep_one_alike(df).collect()) == expected
    assert keep_one_alike(no_docs(spark)).count() == 0 and keep_one_alike(docs(spark)).columns == docs(spark).columns
