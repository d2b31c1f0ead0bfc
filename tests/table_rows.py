"""Rows of a result in a fixed order, for comparison."""


def rows(df):
    return sorted(tuple(r) for r in df.collect())
