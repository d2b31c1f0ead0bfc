"""Dense vectors as array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the portable initialiser.
INIT_MODULUS = 1000003
INIT_ID_STEP = 7919
INIT_POS_STEP = 104729
INIT_SEED_STEP = 1299709
INIT_SHIFT = 12345
INIT_POS_MIX = 31
INIT_MIX = 48271

UNROLLED_DIM = 32


def empty(kind: str) -> Column:
    """An empty array of the type, for rows that go to Python beside others that have one: after each row Spark 4.1 asks for the
    size of the batch so far and passes all null arrays since the last one that is not, so nulls take time by the square."""
    return F.array().cast(kind)


def _same_size(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).otherwise(
        F.raise_error(F.lit("vectors differ in length")).cast("array<double>")
    )


def dot_product(a: Column, b: Column, dim: int | None = None) -> Column:
    """Inner product. With a known `dim` the sum is spelled out and stays in generated code."""
    if dim is None:
        products = _same_size(a, b, F.zip_with(a, b, lambda x, y: x * y))
        return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
    total = F.get(a, F.lit(0)) * F.get(b, F.lit(0))
    for i in range(1, dim):
        total = total + F.get(a, F.lit(i)) * F.get(b, F.lit(i))
    return total


def length_sq(a: Column) -> Column:
    return F.aggregate(F.transform(a, lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x)


def no_nan(vec: Column) -> Column:
    """The vector itself; the job fails when a component is NaN. Infinities pass."""
    return F.when(
        F.exists(vec, lambda x: F.isnan(x)),
        F.raise_error(F.lit("vector component is not a number")).cast("array<double>"),
    ).otherwise(vec)


def vector_add(a: Column, b: Column) -> Column:
    return no_nan(_same_size(a, b, F.zip_with(a, b, lambda x, y: x + y)))


def _mixed(square: Column, key: Column, pos: Column, lo: float, hi: float) -> Column:
    z = F.pmod((square + key + pos * INIT_POS_MIX) * (square + INIT_MIX), F.lit(INIT_MODULUS))
    return F.lit(float(lo)) + (z.cast("double") / float(INIT_MODULUS)) * F.lit(float(hi - lo))


def _reduced(key: Column) -> Column:
    # leaves the result as it is and keeps large keys from overflowing
    return F.pmod(key.cast("bigint"), F.lit(INIT_MODULUS).cast("bigint"))


def _linear(key: Column, pos: Column, seed: int) -> Column:
    return F.pmod(key * INIT_ID_STEP + pos * INIT_POS_STEP + (seed * INIT_SEED_STEP + INIT_SHIFT), F.lit(INIT_MODULUS))


def init_component(key: Column, pos: Column, lo: float, hi: float, seed: int) -> Column:
    """Repeatable pseudo-random number in [lo, hi) from integers alone."""
    k, pos = _reduced(key), pos.cast("bigint")
    x = _linear(k, pos, seed)
    return _mixed(F.pmod(x * x, F.lit(INIT_MODULUS)), k, pos, lo, hi)


def init_vector(key: Column, dim: int, lo: float = -0.001, hi: float = 0.001, seed: int = 1) -> Column:
    if dim <= UNROLLED_DIM:  # stays in generated code
        return F.array(*(init_component(key, F.lit(i), lo, hi, seed) for i in range(dim)))
    k = _reduced(key)
    positions = F.sequence(F.lit(0).cast("bigint"), F.lit(dim - 1).cast("bigint"))
    linear = F.transform(positions, lambda pos: _linear(k, pos, seed))
    squares = F.transform(linear, lambda x: F.pmod(x * x, F.lit(INIT_MODULUS)))
    return F.transform(squares, lambda y, i: _mixed(y, k, i, lo, hi))


def to_fields(df: DataFrame, key: str = "id", vec: str = "vec") -> DataFrame:
    """One row per component: (key, pos, val)."""
    return df.select(key, F.posexplode(vec).alias("pos", "val"))


def from_fields(fields: DataFrame, key: str = "id") -> DataFrame:
    """Components in any order back to one dense vector per key.

    A group holds one vector's components, so it is as long as the vector, whatever the key.
    """
    packed = fields.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "val"))).alias("f"))
    return packed.select(key, F.transform("f", lambda x: x["val"]).alias("vec"))


def fill_missing(fields: DataFrame, keys: DataFrame, dim: int, lo: float, hi: float, seed: int,
                 key: str = "id") -> DataFrame:
    """Fill absent positions 0..dim-1 of each of `keys` with initial values; keep every present field."""
    grid = keys.select(key).distinct().select(
        key, F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("pos")
    )
    return grid.join(fields, [key, "pos"], "full_outer").select(
        key, "pos",
        F.coalesce("val", init_component(F.col(key), F.col("pos"), lo, hi, seed)).alias("val"),
    )
