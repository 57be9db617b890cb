"""Queries for the expressions and the function library."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import fn
from .registry import Tables, query

c = F.col


@query("fn_operators", "E3 E2", "SELECT n_nationkey, (n_nationkey + 1) * 2 AS a, n_nationkey <> 3 AS b, n_nationkey % 5 AS m, n_nationkey IN (1, 2) AS i, CASE WHEN n_nationkey > 10 THEN 'hi' ELSE 'lo' END AS w FROM nation")
def _(t: Tables):
    k = c("n_nationkey")
    return t.nation.select("n_nationkey", fn("*", fn("+", k, 1), 2).alias("a"), fn("!=", k, 3).alias("b"), fn("%", k, 5).alias("m"), fn("in", k, 1, 2).alias("i"), fn("when", k > 10, "hi", "lo").alias("w"))


@query("expr_cast", "E5", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(o_orderdate AS DATE) AS d FROM orders")
def _(t: Tables):
    return t.orders.select("o_orderkey", c("o_orderkey").cast("string").alias("s"), c("o_orderdate").cast("date").alias("d"))


@query("expr_string", "E6", "SELECT o_orderkey, o_totalprice / 2 + 1 AS h FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000")
def _(t: Tables):
    return t.orders.where(F.expr("o_totalprice between 1000 and 200000")).select("o_orderkey", F.expr("o_totalprice / 2 + 1").alias("h"))


@query("expr_star", "E7", "SELECT *, r_regionkey + 1 AS next FROM region")
def _(t: Tables):
    return t.region.select("*", (c("r_regionkey") + 1).alias("next"))


@query("get_item", "E8 F60", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[3] AS DOUBLE) AS third, label + 1 AS field FROM embeddings")
def _(t: Tables):
    s = F.struct((c("label") + 1).alias("x"))
    return t.embeddings.select("vec_id", c("embedding").getItem(0).cast("double").alias("first"), F.element_at("embedding", 3).cast("double").alias("third"), s.getField("x").alias("field"))


@query("col_regex", "E9", "SELECT c_custkey, c_acctbal FROM customer")
def _(t: Tables):
    return t.customer.select(t.customer.colRegex("`c_(custkey|acctbal)`"))


@query("call_function", "E10", "SELECT n_nationkey, lower(n_name) AS n FROM nation")
def _(t: Tables):
    return t.nation.select("n_nationkey", F.call_function("lower", c("n_name")).alias("n"))


def _over(column: Column) -> Column:
    return column.over(_window())


def _window():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


_OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
for _n, _make, _sql in [
    ("row_number", lambda: F.row_number(), f"CAST(row_number() {_OVER} AS INTEGER)"),
    ("ntile", lambda: F.ntile(4), f"CAST(ntile(4) {_OVER} AS INTEGER)"),
    ("lag", lambda: F.lag("o_orderkey", 1), f"lag(o_orderkey, 1) {_OVER}"),
    ("lag_default", lambda: F.lag("o_orderkey", 2, -1), f"lag(o_orderkey, 2, -1) {_OVER}"),
    ("lead", lambda: F.lead("o_orderkey", 1), f"lead(o_orderkey, 1) {_OVER}"),
    ("first_last", lambda: F.first("o_orderkey"), f"first_value(o_orderkey) {_OVER}"),
]:

    @query(f"win_{_n}", "E11 F11 F14 F15 F16 F7", f"SELECT o_orderkey, {_sql} AS w FROM orders")
    def _(t: Tables, make=_make):
        return t.orders.select("o_orderkey", _over(make()).alias("w"))


@query("win_rank", "E11 F12", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INTEGER) AS w FROM orders")
def _(t: Tables):
    return t.orders.select("o_orderkey", F.rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")).alias("w"))


@query("win_dense_rank", "E11 F13", "SELECT o_orderkey, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INTEGER) AS w FROM orders")
def _(t: Tables):
    return t.orders.select("o_orderkey", F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")).alias("w"))


@query("win_running_rows", "E11", f"SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) {_OVER[:-1]} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS w FROM orders")
def _(t: Tables):
    return t.orders.select("o_orderkey", F.sum(c("o_totalprice").cast("decimal(18,2)")).over(_window().rowsBetween(-2, 0)).cast("double").alias("w"))


@query("win_range_frame", "E11", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS w FROM lineitem")
def _(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.count("*").over(Window.partitionBy("l_suppkey").orderBy("l_orderkey").rangeBetween(-100, 0)).alias("w"))


@query("hof", "E12 E13 F64 F65 F66 F67 F68", "SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)) AS INTEGER) AS pos, CAST(len(list_filter(embedding, lambda x: x > 0.1)) AS INTEGER) AS big, len(list_filter(embedding, lambda x: NOT (x < 1))) = 0 AS every, CAST(len(list_zip(embedding, embedding)) AS INTEGER) AS zipped FROM embeddings")
def _(t: Tables):
    e = c("embedding")
    signs = F.transform(e, lambda x: F.when(x > 0, 1).otherwise(0))
    return t.embeddings.select("vec_id", F.aggregate(signs, F.lit(0), lambda a, x: a + x).alias("pos"), F.size(F.filter(e, lambda x: x > 0.1)).alias("big"), F.forall(e, lambda x: x < 1).alias("every"), F.size(F.zip_with(e, e, lambda x, y: x + y)).alias("zipped"))


@query("subq_scalar", "E14", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT max(c_acctbal) * 30 FROM customer)")
def _(t: Tables):
    return t.orders.where(c("o_totalprice") > t.customer.agg((F.max("c_acctbal") * 30).alias("m")).scalar()).select("o_orderkey")


@query("subq_exists", "E14", "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)")
def _(t: Tables):
    inner = t.supplier.where((c("s_nationkey") == c("n.n_nationkey").outer()) & (c("s_acctbal") > 9000))
    return t.nation.alias("n").where(inner.exists()).select("n_name")


@query("subq_in", "E14", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def _(t: Tables):
    return t.customer.where(c("c_nationkey").isin(t.nation.where("n_regionkey = 1").select("n_nationkey"))).select("c_custkey")


@query("fn_aggregates", "F1 F2 F3 F4 F5 F6 F9 F10", "SELECT n_regionkey, count(n_name) AS n, CAST(sum(n_nationkey) AS BIGINT) AS s, avg(n_nationkey) AS a, min(n_name) AS least, max(n_name) AS most, list_sort(list(n_nationkey)) AS all_keys, CAST(len(list(DISTINCT n_nationkey % 3)) AS INTEGER) AS kinds FROM nation GROUP BY 1")
def _(t: Tables):
    k = c("n_nationkey")
    return t.nation.groupBy("n_regionkey").agg(F.count("n_name").alias("n"), F.sum(k).alias("s"), F.mean(k).alias("a"), F.min("n_name").alias("least"), F.max("n_name").alias("most"), F.sort_array(F.collect_list(k)).alias("all_keys"), F.size(F.collect_set(k % 3)).alias("kinds"))


@query("fn_last", "F8", f"SELECT o_orderkey, last_value(o_orderkey) {_OVER[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS w FROM orders")
def _(t: Tables):
    return t.orders.select("o_orderkey", F.last("o_orderkey").over(_window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("w"))


@query("fn_strings", "F17 F18 F19 F20 F21 F22 F23 F24 F25", "SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, trim('  ' || c_name || ' ') AS t, CAST(length(c_name) AS INTEGER) AS n, c_name || '!' AS c, concat_ws('-', c_name, c_mktsegment) AS w, substring(c_name, 2, 4) AS s, string_split_regex(c_name, '#') AS p, regexp_replace(c_name, '[0-9]+', '_', 'g') AS r FROM customer")
def _(t: Tables):
    n = c("c_name")
    return t.customer.select("c_custkey", F.upper(n).alias("u"), F.lower(n).alias("l"), F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("t"), F.length(n).alias("n"), F.concat(n, F.lit("!")).alias("c"), F.concat_ws("-", n, "c_mktsegment").alias("w"), F.substring(n, 2, 4).alias("s"), F.split(n, "#").alias("p"), F.regexp_replace(n, "[0-9]+", "_").alias("r"))


@query("fn_dates", "F26 F27 F28 F29 F30 F31 F32 F33 F34 F37 F38 F39", "SELECT event_id, CAST(ts AS DATE) AS d, date_trunc('hour', ts) AS h, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS dd, CAST(hour(ts) AS INTEGER) AS hh, CAST(minute(ts) AS INTEGER) AS mi, CAST(second(ts) AS INTEGER) AS ss, CAST(ts AS DATE) + 3 AS plus, CAST(ts AS DATE) - 3 AS minus, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS days, DATE '2024-02-03' AS td, TIMESTAMP '2024-02-03 04:05:06' AS tt FROM events")
def _(t: Tables):
    ts = c("ts")
    return t.events.select("event_id", F.to_date(ts).alias("d"), F.date_trunc("hour", ts).cast("timestamp_ntz").alias("h"), F.year(ts).alias("y"), F.month(ts).alias("m"), F.dayofmonth(ts).alias("dd"), F.hour(ts).alias("hh"), F.minute(ts).alias("mi"), F.second(ts).alias("ss"), F.date_add(F.to_date(ts), 3).alias("plus"), F.date_sub(F.to_date(ts), 3).alias("minus"), F.datediff(F.to_date(ts), F.lit("2024-01-01").cast("date")).alias("days"), F.to_date(F.lit("03/02/2024"), "dd/MM/yyyy").alias("td"), F.to_timestamp(F.lit("2024-02-03 04:05:06")).cast("timestamp_ntz").alias("tt"))


@query("fn_now", "F35 F36", "SELECT true AS d, true AS t")
def _(t: Tables):
    return t.spark.range(1).select((F.current_date() >= F.lit("2024-01-01").cast("date")).alias("d"), F.current_timestamp().isNotNull().alias("t"))


@query("fn_math", "F40 F41 F42 F43 F44 F45 F46 F47 F48 F49", "SELECT event_id, abs(value - 50) AS a, round(value, 1) AS r, CAST(floor(value) AS BIGINT) AS f, CAST(ceil(value) AS BIGINT) AS c, round(sqrt(abs(value)), 6) AS s, round(power(value, 2), 4) AS p, round(exp(value / 1000), 6) AS e, round(ln(abs(value) + 1), 6) AS l, greatest(value, 20.0) AS g, least(value, 20.0) AS le FROM events")
def _(t: Tables):
    v = c("value")
    return t.events.select("event_id", F.abs(v - 50).alias("a"), F.round(v, 1).alias("r"), F.floor(v).alias("f"), F.ceil(v).alias("c"), F.round(F.sqrt(F.abs(v)), 6).alias("s"), F.round(F.pow(v, F.lit(2.0)), 4).alias("p"), F.round(F.exp(v / 1000), 6).alias("e"), F.round(F.log(F.abs(v) + 1), 6).alias("l"), F.greatest(v, F.lit(20.0)).alias("g"), F.least(v, F.lit(20.0)).alias("le"))


@query("fn_nulls", "F50 F51 F52 F53", "SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN value END, -1.0) AS c, (CASE WHEN event_id % 2 = 0 THEN value END) IS NULL AS n, isnan(value) AS nan, CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END AS w FROM events")
def _(t: Tables):
    v, gap = c("value"), F.when(c("event_id") % 2 == 0, c("value"))
    return t.events.select("event_id", F.coalesce(gap, F.lit(-1.0)).alias("c"), F.isnull(gap).alias("n"), F.isnan(v).alias("nan"), F.when(v > 50, "high").when(v > 10, "mid").otherwise("low").alias("w"))


@query("fn_complex", "F54 F55 F56 F59 F61 F62 F63", "SELECT n_nationkey, n_nationkey + 1 AS field, [n_nationkey, 7] AS arr, CAST(2 AS INTEGER) AS n, n_nationkey IN (3, 7) OR n_nationkey = 7 AS has, [n_name] AS keys, [n_nationkey] AS vals FROM nation")
def _(t: Tables):
    k = c("n_nationkey")
    a, m = F.array(k, F.lit(7)), F.create_map(c("n_name"), k)
    return t.nation.select("n_nationkey", F.struct((k + 1).alias("x"))["x"].alias("field"), a.alias("arr"), F.size(a).alias("n"), F.array_contains(F.array(k, F.when(k == 3, 7)), 7).eqNullSafe(True).alias("has"), F.map_keys(m).alias("keys"), F.map_values(m).alias("vals"))


@query("fn_explode", "F57", "SELECT vec_id, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x FROM embeddings")
def _(t: Tables):
    return t.embeddings.select("vec_id", F.explode(F.transform("embedding", lambda x: x.cast("double"))).alias("x"))


@query("fn_explode_outer", "F58", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS x FROM nation")
def _(t: Tables):
    return t.nation.select("n_nationkey", F.explode_outer(F.when(c("n_nationkey") % 2 == 0, F.array("n_name"))).alias("x"))


@query("fn_digests", "F70 F71", "SELECT p_partkey, md5(p_name) AS m, sha256(p_name) AS s FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", F.md5("p_name").alias("m"), F.sha2("p_name", 256).alias("s"))


@query("fn_unstable", "F69 F72 F73", "SELECT CAST(-1321691492 AS INTEGER) AS h, count(*) AS ids, true AS r FROM orders")
def _(t: Tables):
    """The hash of the documented example, as many different ids as rows, numbers in [0, 1) that are all different from one another but for a few."""
    rows = t.orders.select(F.monotonically_increasing_id().alias("i"), F.rand(3).alias("r"))
    spread = (F.min("r") >= 0) & (F.max("r") < 1) & (F.abs(F.avg("r") - 0.5) < 0.1)
    return rows.agg(F.hash(F.lit("Spark"), F.array(F.lit(123)), F.lit(2)).alias("h"), F.countDistinct("i").alias("ids"), spread.alias("r"))


@query("fn_json", "E3", "SELECT event_id, props AS j, json_extract_string(props, '$.k') AS k FROM events")
def _(t: Tables):
    return t.events.select("event_id", F.col("props").alias("j"), F.get_json_object("props", "$.k").alias("k"))


@query("fn_window_tumbling", "E3", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t: Tables):
    return t.events.groupBy(F.window(c("ts").cast("timestamp"), "1 day"), "event_type").agg(F.count("*").alias("n")).select(c("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")
