"""Edge cases of sources, functions and operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from planweave import operators as ops
from planweave import sources as src
from planweave.functions import fn


def test_inline_types_widen_and_nulls_follow(spark):
    df = src.inline(spark, [(1, 2, "a", None), (2**40, 2.5, None, True)])
    assert df.dtypes == [("_1", "bigint"), ("_2", "double"), ("_3", "string"), ("_4", "boolean")]
    assert df.collect()[0][:3] == (1, 2.0, "a")


def test_inline_keeps_values_exactly(spark):
    cells = ["\\t", "\\d", "it's", "", "\n", "ü|%"]
    assert [r[0] for r in src.inline(spark, cells).collect()] == cells
    x = [r[0] for r in src.inline(spark, [float("nan"), float("inf"), -0.0]).collect()]
    assert math.isnan(x[0]) and x[1] == math.inf


@pytest.mark.parametrize("rows,names", [([], None), ([(1,), (1, 2)], None), ([(1,)], ["a", "b"]), ([(None,)], None), ([(1,), ("a",)], None), ([(True,), (1,)], None)])
def test_inline_rejects(spark, rows, names):
    with pytest.raises(ValueError):
        src.inline(spark, rows, names)


def test_inline_limits(spark):
    src.inline(spark, [(k,) for k in range(1000)])
    with pytest.raises(src.InlineTableTooLarge):
        src.inline(spark, [(k,) for k in range(1001)])
    src.inline(spark, [("x" * 65536,)])
    with pytest.raises(src.InlineTableTooLarge):
        src.inline(spark, [("x" * 65537,)])


def test_rate_ignores_a_declared_schema(spark):
    df = src.source(spark, "rate", schema="timestamp timestamp, value bigint", streaming=True)
    assert df.isStreaming and df.columns == ["timestamp", "value"]


def test_parse_text(spark):
    df = src.inline(spark, [('{"a": 1, "b": "x"}',), ("{bad",), (None,)], ["value"])
    assert [r["a"] for r in src.parse_text(df, "value", "json").collect()] == [1, None, None]
    with pytest.raises(ValueError):
        src.parse_text(df, "value", "xml")


def test_missing_names_in_to_schema_are_null(spark):
    rows = ops.to_schema(spark.range(2), "value bigint, id int").collect()
    assert [tuple(r) for r in rows] == [(None, 0), (None, 1)]


def test_operators_by_name(spark):
    row = spark.range(1).select(fn("!=", F.lit(1), 2).alias("a"), fn("and", F.lit(True), F.lit(False)).alias("b"), fn("in", F.lit(3), 1, 3).alias("c"), fn("upper", "x").alias("d")).first()
    assert tuple(row) == (True, False, True, "X")


def test_distinct_aggregates(spark):
    df = spark.createDataFrame([(1,), (1,), (4,)], "x int")
    assert tuple(df.agg(fn("sum", F.col("x"), distinct=True), fn("count", F.col("x"), distinct=True), fn("max", F.col("x"), distinct=True)).first()) == (5, 2, 4)


def test_sequential_columns_and_renames(spark):
    df = spark.range(1).withColumn("a", F.lit(1)).withColumn("a", F.col("a") + 1).withColumn("b", F.col("a") + 1)
    assert df.first()["b"] == 3
    assert spark.range(1).withColumnRenamed("id", "b").withColumnRenamed("b", "c").columns == ["c"]


def test_tail(spark):
    df = spark.range(10).repartition(3)
    assert [r[0] for r in ops.tail(df, 3, ["id"]).collect()] == [7, 8, 9]
    assert [r[0] for r in ops.tail(df, 2, [("id", "desc")]).collect()] == [1, 0]
    assert ops.tail(spark.range(4).coalesce(1), 2).count() == 2


def test_observe(spark):
    df, seen = ops.observe(spark.range(7), "m", F.count("*").alias("n"))
    df.collect()
    assert seen.get == {"n": 7}


def brute(left, right, direction, exact, tolerance):
    out = []
    for lid, k, t in left:
        best = None
        for rid, rk, rt in right:
            if None in (k, t, rk, rt) or k != rk or (tolerance is not None and abs(t - rt) > tolerance):
                continue
            back = rt < t or (exact and rt == t)
            forth = rt > t or (exact and rt == t)
            if direction == "backward" and not back or direction == "forward" and not forth or direction == "nearest" and not (back or forth):
                continue
            rank = (-abs(t - rt), rt <= t, rid)
            if best is None or rank > best[0]:
                best = (rank, rid)
        out.append((lid, best and best[1]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("exact,tolerance", [(True, None), (False, None), (True, 3)])
def test_as_of_join(spark, keyed, direction, exact, tolerance):
    rng = random.Random(5)
    pick = lambda: rng.choice([None, *range(20)])
    left = [(i, rng.choice([1, 2, None]) if keyed else 1, pick()) for i in range(40)]
    right = [(i, rng.choice([1, 2, None]) if keyed else 1, pick()) for i in range(30)]
    l = spark.createDataFrame(left, "id long, k int, t long")  # noqa: E741
    r = spark.createDataFrame(right, "rid long, k int, t long").select("k", "t", "rid")
    if not keyed:
        l, r = l.drop("k"), r.drop("k")  # noqa: E741
    got = ops.as_of_join(l, r, "t", "t", by=["k"] if keyed else [], direction=direction, allow_exact=exact, tolerance=tolerance)
    assert "t_right" in got.columns
    assert sorted(((x["id"], x["rid"]) for x in got.collect()), key=repr) == brute(left, right, direction, exact, tolerance)
    inner = ops.as_of_join(l, r, "t", "t", by=["k"] if keyed else [], direction=direction, allow_exact=exact, tolerance=tolerance, how="inner")
    assert inner.count() == sum(x["rid"] is not None for x in got.collect())


def test_as_of_join_in_a_zone_with_summer_time(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        times = ["2024-03-10 01:59:59.5", "2024-03-10 02:30:00", "2024-03-10 03:05:00", "2024-11-03 01:10:00", "2024-11-03 01:50:00.000001", "1960-01-01 00:00:00.25"]
        left = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({k}, TIMESTAMP_NTZ'{t}')" for k, t in enumerate(times)) + " v(id, t)")
        right = left.select((F.col("id") + 100).alias("rid"), F.col("t").alias("seen"))
        back = {r["id"]: r["rid"] for r in ops.as_of_join(left, right, "t", "seen", allow_exact=False).collect()}
        assert back == {0: 105, 1: 100, 2: 101, 3: 102, 4: 103, 5: None}
        near = {r["id"]: r["rid"] for r in ops.as_of_join(left, right, "t", "seen", allow_exact=False, tolerance=2400.000001).collect()}
        assert near == {0: None, 1: 100, 2: 101, 3: None, 4: 103, 5: None}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_as_of_join_deals_one_key_to_several_tasks(spark):
    rows = spark.range(4000).select(F.when(F.col("id") < 3900, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("t"), F.col("id").alias("n")).repartition(3)
    left, right = rows.where("n % 2 = 0"), rows.where("n % 7 = 0").withColumnRenamed("n", "m")
    for direction, want in (("backward", lambda n: n - n % 7), ("forward", lambda n: n + -n % 7)):
        out = ops.as_of_join(left, right, "t", "t", by=["k"], direction=direction)
        assert out.where("k = 1").select(F.spark_partition_id()).distinct().count() > 1
        got = {r["n"]: r["m"] for r in out.where("k = 1").collect()}
        assert got == {n: want(n) if want(n) < 3900 else None for n in range(0, 3900, 2)}


def test_quantiles_are_lazy_and_bounded(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"), F.lit(None).cast("double").alias("none"))
    assert ops.approx_quantile(df, ["x", "none"], [0.1, 0.5], 1e-6).first()[0] == [[99.0, 499.0], None]
    with pytest.raises(ValueError):
        ops.approx_quantile(df, ["x"], [0.5], 0.0)


def test_tail_without_an_order_is_bounded(spark):
    with pytest.raises(ValueError):
        ops.tail(spark.range(3), ops.TAIL + 1)


def test_any_distinct_aggregate(spark):
    df = spark.createDataFrame([(1,), (1,), (4,), (None,)], "x int")
    row = df.agg(fn("avg", F.col("x"), distinct=True).alias("a"), F.sort_array(fn("collect_list", F.col("x"), distinct=True)).alias("l"), fn("count", F.col("x"), F.lit(1), distinct=True).alias("c"), fn("stddev", F.col("x"), distinct=True).alias("s")).first()
    assert (row["a"], row["l"], row["c"]) == (2.5, [1, 4], 2) and abs(row["s"] - 4.5**0.5) < 1e-12
