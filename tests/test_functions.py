import math

import pytest
from table_rows import rows
from pyspark.sql import functions as F

from foldstream.functions import metrics as m
from foldstream.functions import vectors as v


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def vec(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


def items(*xs):
    return F.array(*(F.lit(x) for x in xs))


def test_dot_and_length(spark):
    assert value(spark, v.dot_product(vec(1, 2, 3, 4), vec(1, 1, 1, 1))) == 10.0
    assert value(spark, v.dot_product(vec(1, 2, 3, 4), vec(1, 1, 1, 1), 4)) == 10.0
    assert value(spark, v.length_sq(vec(1, 2, 3, 4))) == 30.0
    assert value(spark, v.length_sq(vec(1, 1, 1, 1))) == 4.0


def test_add(spark):
    inf = math.inf
    assert value(spark, v.vector_add(vec(1, 2, 3, 4), vec(1, 1, 1, 1))) == [2, 3, 4, 5]
    assert value(spark, v.vector_add(vec(0, -inf), vec(1, 1))) == [1, -inf]
    assert value(spark, v.vector_add(vec(1, inf), vec(1, 1))) == [2, inf]


@pytest.mark.parametrize("a, b", [((1, math.inf), (0, -math.inf)), ((1, 2), (1, 2, 3))])
def test_add_fails(spark, a, b):
    with pytest.raises(Exception, match="not a number|differ in length"):
        value(spark, v.vector_add(vec(*a), vec(*b)))


@pytest.mark.parametrize("topk, dcg, ndcg", [
    ((2, 4, 6, 8, 10), 1.630930, 0.553146), ((6, 7, 8, 9, 10), 0.0, 0.0), ((0, 2, 3, 6, 4), 1.517783, 0.514771)])
def test_many_targets(spark, topk, dcg, ndcg):
    targets = items(1, 2, 3, 4, 5)
    assert value(spark, m.dcg(items(*topk), targets)) == pytest.approx(dcg, abs=1e-6)
    assert value(spark, m.ndcg_list(items(*topk), targets)) == pytest.approx(ndcg, abs=1e-6)


def test_ideal(spark):
    assert value(spark, m.ideal_dcg(F.lit(5), F.lit(10))) == pytest.approx(2.948459, abs=1e-6)
    assert value(spark, m.ideal_dcg(F.lit(5), F.lit(2))) == pytest.approx(1.630930, abs=1e-6)
    assert value(spark, m.ideal_dcg(F.lit(0), F.lit(3))) == 0.0


def test_nothing_to_gain_is_nan(spark):
    none = F.array().cast("array<int>")
    assert math.isnan(value(spark, m.ndcg_list(items(1, 2), none)))
    assert math.isnan(value(spark, m.ndcg_list(none, items(1, 2))))


@pytest.mark.parametrize("target, expected", [(1, 1.0), (2, 0.5), (3, 0.386853), (100, 0.130824), (101, 0.0)])
def test_single_target(spark, target, expected):
    topk = F.sequence(F.lit(1), F.lit(100))
    assert value(spark, m.ndcg_single(topk, F.lit(target))) == pytest.approx(expected, abs=1e-6)


def test_repeated_hits_count_again(spark):
    once = value(spark, m.dcg(items(1, 9), items(1)))
    assert value(spark, m.dcg(items(1, 1), items(1))) == pytest.approx(once + 1 / math.log2(3))


def test_init_forms_agree(spark):
    ids = spark.range(-50, 50)
    short = v.init_vector(F.col("id"), 10, -1.0, 1.0, 2)
    long = F.slice(v.init_vector(F.col("id"), 40, -1.0, 1.0, 2), 1, 10)
    assert ids.where(short != long).count() == 0
    assert ids.where(F.exists(short, lambda x: (x < -1.0) | (x >= 1.0))).count() == 0
    big = value(spark, v.init_vector(F.lit(9_000_000_000_000_000_000), 3))
    assert len(big) == 3


def test_fields_roundtrip(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [4.0])], "id bigint, vec array<double>")
    fields = v.to_fields(df).orderBy(F.desc("pos"))
    assert [(i, list(x)) for i, x in rows(v.from_fields(fields))] == [(1, [1.0, 2.0, 3.0]), (2, [4.0])]


def test_fill_missing(spark):
    fields = spark.createDataFrame([(1, 1, 5.0), (7, 0, 2.0)], "id bigint, pos int, val double")
    keys = spark.createDataFrame([(1,)], "id bigint")
    filled = {(i, p): x for i, p, x in rows(v.fill_missing(fields, keys, 3, -1.0, 1.0, 1))}
    start = value(spark, v.init_vector(F.lit(1), 3, -1.0, 1.0, 1))
    assert filled == {(1, 0): start[0], (1, 1): 5.0, (1, 2): start[2], (7, 0): 2.0}
