"""Awkward tables shared by the tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, component_id long"
_WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo".split()


def prose(n: int, step: int = 1) -> str:
    """n words without a repeated passage."""
    out, x = [], step
    for _ in range(n):
        x = (x * 48271 + step) % 2147483647
        out.append(_WORDS[x % len(_WORDS)] + _WORDS[x // 64 % len(_WORDS)])
    return " ".join(out)


def rows():
    """Nulls in every column, an empty, a blank and a very long text, repeated rows, copies and ties."""
    extra = ("x", "y", 7)
    long_text = prose(30_000, 9)
    same = prose(60, 3)
    return [
        (1, prose(50, 1), "en", "b", 10, *extra),
        (1, prose(50, 1), "en", "b", 10, *extra),  # the same row again
        (2, prose(50, 1), "en", "a", 10, *extra),  # a copy
        (3, None, "en", "a", None, *extra),
        (4, "", None, None, 0, None, None, None),
        (5, " \n\t ", "fr", "b", 4, *extra),
        (None, same, "fr", None, 1, *extra),
        (7, same + " omega", "fr", "c", 1, *extra),
        (8, long_text, "en", "c", 1, *extra),
        (9, "é漢字 😀 naïve token = \"0123456789abcdef0123456789abcdef01234567\"", "fr", "c", 1, *extra),
        (10, "A" * 5_000, "en", "c", 1, *extra),
    ]


def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)
