"""Secret scans with DataFrame functions only.

Three kinds of secrets are known by their form (fixed patterns below). A fourth is known by its
randomness: over a candidate, a run of token characters, a window of fixed width moves by one character at a
time. The sum of c * log2(c) over the window's character counts changes by the leaving and the entering
character alone, and gives the window's Shannon entropy. A candidate whose best window reaches the threshold of
its character class is a secret, unless the allow-list knows its form.

Positions are code points. A pattern's matches and the gaps between them give them by running sums; those are
taken in blocks, so a text with very many matches costs little more than its length.

Defined results: a null or empty text has no spans. Repeated rows are scanned one by one, and other columns play
no part. Spans may overlap; redaction merges what overlaps.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns; the keyword's letters match in either case.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a run of AKIA[A-Z0-9]+ with 16 characters or more
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8
KINDS = ["assign", "access", "hex", "entropy"]
SPANS = "array<struct<start:int,kind:int,stop:int>>"
BLOCK = 128
PLACEHOLDER = "<SECRET>"


@dataclass(frozen=True)
class EntropyRules:
    """A candidate is a run of `least` characters or more; `window` its window, at most `least`.

    hexadecimal, mixed: bits a character from which a window counts, by the candidate's character class. A candidate
    of the class `mixed` has digits, small and capital letters; of `hexadecimal`, hexadecimal digits only. Of all others the
    parts of letters and digits that hold a window count: hexadecimal ones as above, `small` with digits and small
    letters, `capital` with digits and capitals, `letters` with letters of both cases, of which `balance` or more must be of
    either case (names in camel case have few capitals). What is left is ordinary text. allowed: forms that are no secrets however random, as full matches.
    """

    least: int = 24
    window: int = 20
    hexadecimal: float = 2.93
    mixed: float = 3.53
    small: float = 3.48
    capital: float = 3.4
    letters: float = 3.62
    balance: float = 0.3
    candidate: str = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}"  # tried at the starts of runs only
    allowed: tuple[str, ...] = (
        r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUID
        r"[0-9A-Z]*(?i:example)[0-9A-Za-z]*",  # documentation keys
        r"(?!.*//)/[a-z0-9_/-]+",  # paths: no repeated group, so long ones cost no stack
        r"[0-9=+/_-]+",  # numbers and rules
    )


def _running(lengths: Column) -> Column:
    """Running sums of an int array, each without its own value; sums of whole blocks are added up first."""
    zero = F.lit(0)
    add = lambda a, b: a + b
    blocks = F.transform(F.sequence(zero, F.floor((F.size(lengths) - 1) / BLOCK).cast("int")),
                         lambda b: F.aggregate(F.slice(lengths, b * BLOCK + 1, BLOCK), zero, add))

    def upto(i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        return (F.aggregate(F.slice(blocks, F.lit(1), block), zero, add)
                + F.aggregate(F.slice(lengths, block * BLOCK + 1, i - block * BLOCK), zero, add))

    return F.transform(F.sequence(zero, F.size(lengths) - 1), upto)


def matches(df: DataFrame, text_col: str, pattern: str, into: str, cheap: Column | None = None) -> DataFrame:
    """Add an array of (start, found) for the leftmost non-overlapping matches, null if there are none.

    `cheap`: a condition that every text with a match meets.
    """
    text = F.col(text_col)
    hit = text.rlike(pattern) if cheap is None else cheap & text.rlike(pattern)
    # one projection each, so that no regular expression is evaluated twice
    df = df.withColumn("_found", F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    df = df.withColumn("_gaps", F.when(F.col("_found").isNotNull(), F.split(text, pattern, -1)))
    lengths = F.zip_with(F.slice("_gaps", F.lit(1), F.size("_found")), F.col("_found"), lambda g, f: F.length(g) + F.length(f))
    df = df.withColumn("_steps", lengths)
    before = F.when(F.col("_found").isNotNull(), _running(F.col("_steps")))
    df = df.withColumn("_before", before)
    return df.withColumn(into, F.transform(
        F.arrays_zip("_before", "_gaps", "_found"),
        lambda x: F.struct((x["_before"] + F.length(x["_gaps"])).alias("start"), x["_found"].alias("found")))
    ).withColumn(into, F.filter(into, lambda x: x["found"].isNotNull())).drop("_found", "_gaps", "_steps", "_before")


def _reaches(found: Column, window: int, least: Column) -> Column:
    """Whether a window of the string has a Shannon entropy of `least` bits a character or more.

    The string is cut, in one pass, into blocks that overlap by a window less one character, so that a step costs the
    length of a block and not of the string; the first block that reaches the threshold ends the search.
    """
    blocks = F.regexp_extract_all(found, F.lit(f"(?=(.{{{window},{BLOCK + window - 1}}})).{{1,{BLOCK}}}"), F.lit(1))
    # beside each block, so that the threshold is worked out once and not for every block
    both = F.arrays_zip(blocks.alias("block"), F.array_repeat(least, F.size(blocks)).alias("least"))
    return F.exists(both, lambda x: _best_entropy(x["block"], window) >= x["least"])


def _best_entropy(found: Column, window: int) -> Column:
    """Largest Shannon entropy, in bits a character, of a window of the block.

    The state is s, the sum of c * log2(c) over the window's counts c; when the window moves, only the counts of
    the leaving and of the entering character change.
    """
    def weigh(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))

    def count(char: Column, part: Column) -> Column:
        return (F.length(part) - F.length(F.replace(part, char, F.lit("")))).cast("double")

    first = F.substring(found, 1, window)
    start = F.aggregate(F.sequence(F.lit(1), F.lit(window)), F.lit(0.0), lambda acc, i: acc + F.log2(
        F.greatest(count(F.substring(first, i, F.lit(1)), first), F.lit(1.0))))
    moved = F.aggregate(
        F.when(F.length(found) > window, F.sequence(F.lit(2), F.length(found) - window + 1)).otherwise(F.array().cast("array<int>")),
        F.struct(start.alias("s"), start.alias("least")),
        lambda acc, i: _moved(acc, found, i, window, weigh, count))
    return F.log2(F.lit(float(window))) - moved["least"] / window


def _moved(acc: Column, found: Column, i: Column, window: int, weigh, count) -> Column:
    old = F.substring(found, i - 1, F.lit(window))
    kept = F.substring(found, i, F.lit(window - 1))
    out_, in_ = F.substring(found, i - 1, F.lit(1)), F.substring(found, i + window - 1, F.lit(1))
    c_out, c_in = count(out_, old), count(in_, kept)
    s = acc["s"] - weigh(c_out) + weigh(c_out - 1) - weigh(c_in) + weigh(c_in + 1)
    return F.struct(s.alias("s"), F.least(acc["least"], s).alias("least"))


def _is_hexadecimal(found: Column) -> Column:
    return found.rlike(r"\A[0-9a-fA-F]+\z") & found.rlike("[0-9]") & found.rlike("[a-fA-F]")


def _random_part(part: Column, rules: EntropyRules) -> Column:
    """Whether a run of letters and digits reaches the threshold of its class."""
    digit, small, capital = part.rlike("[0-9]"), part.rlike("[a-z]"), part.rlike("[A-Z]")
    share = F.length(F.regexp_replace(part, "[^A-Z]", "")) / F.length(part)
    least = (F.when(_is_hexadecimal(part), F.lit(rules.hexadecimal)).when(digit & small & capital, F.lit(rules.mixed))
             .when(digit & small, F.lit(rules.small)).when(digit & capital, F.lit(rules.capital))
             .when(~digit & share.between(rules.balance, 1 - rules.balance), F.lit(rules.letters)))
    return F.coalesce(F.when(least.isNotNull(), _reaches(part, rules.window, least)), F.lit(False))


def _random(found: Column, rules: EntropyRules) -> Column:
    """Whether a candidate's best window, or that of a part, reaches the threshold of its class and no allowed form fits."""
    mixed = found.rlike("[0-9]") & found.rlike("[a-z]") & found.rlike("[A-Z]")
    least = F.when(_is_hexadecimal(found), F.lit(rules.hexadecimal)).when(mixed, F.lit(rules.mixed))
    allowed = found.rlike(r"\A(?:" + "|".join(f"(?:{a})" for a in rules.allowed) + r")\z")
    parts = F.regexp_extract_all(found, F.lit(f"[A-Za-z0-9]{{{rules.window},}}"), F.lit(0))
    return (F.when(allowed, F.lit(False)).when(least.isNotNull(), _reaches(found, rules.window, least))
            .otherwise(F.exists(parts, lambda part: _random_part(part, rules))))


def _span_of(kind: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"),
                              (x["start"] + F.length(x["found"])).alias("stop"))


def scan(docs: DataFrame, text_col: str = "text", into: str = "_spans", rules: EntropyRules = EntropyRules()) -> DataFrame:
    """All columns and `into`: every span as (start, kind, stop), kind a position in KINDS, sorted. No shuffle."""
    if rules.window > rules.least:
        raise ValueError("a candidate must hold a window")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    df = docs.select("*", F.coalesce(f"`{text_col}`", F.lit("")).alias("_text"))
    text = F.col("_text")
    small = F.lower(text)
    keyword = reduce(Column.__or__, [F.contains(small, F.lit(k)) for k in ("passw", "secret", "token", "key")])
    for kind, pattern, cheap in ((0, ASSIGN, keyword), (1, ACCESS, F.contains(text, F.lit("AKIA"))), (2, HEX, None),
                                 (3, rules.candidate, None)):
        df = matches(df, "_text", pattern, f"_kind{kind}", cheap)
    keep = {0: lambda x: F.length(F.regexp_extract(x["found"], ASSIGN, 1)) >= ASSIGN_LEAST,
            3: lambda x: _random(x["found"], rules)}
    spans = []
    for kind in range(len(KINDS)):
        found = F.col(f"_kind{kind}")
        found = F.filter(found, keep[kind]) if kind in keep else found
        spans.append(F.coalesce(F.transform(found, _span_of(kind)), F.array().cast(SPANS)))
    return df.select(*columns, F.array_sort(F.concat(*spans)).cast(SPANS).alias(into))


def written(spans: Column | str) -> Column:
    """kind:start:stop of each span, comma-joined."""
    names = F.lit(KINDS)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["stop"])), ",")


def redact(docs: DataFrame, text_col: str = "text", rules: EntropyRules = EntropyRules()) -> DataFrame:
    """All columns, with PLACEHOLDER for every stretch of text under spans; texts without spans stay as they are."""
    df = scan(docs, text_col, "_spans", rules)
    text = F.col(f"`{text_col}`")
    # spans by start; each piece of text lies between the furthest stop so far and the next start
    pieces = F.aggregate(
        "_spans", F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, x: F.when(x["start"] + 1 >= acc["at"], F.struct(
            (x["stop"] + 1).alias("at"), F.concat(acc["parts"], F.array(
                F.substring(text, acc["at"], x["start"] + 1 - acc["at"]), F.lit(PLACEHOLDER))).alias("parts")))
        .otherwise(F.struct(F.greatest(acc["at"], x["stop"] + 1).alias("at"), acc["parts"].alias("parts"))))
    df = df.withColumn("_pieces", F.when(F.size("_spans") > 0, pieces))
    whole = F.concat(F.array_join("_pieces.parts", ""), F.substring(text, F.col("_pieces.at"), F.length(text)))
    changed = F.when(F.col("_pieces").isNull(), text).otherwise(whole)
    return df.select(*(changed.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
