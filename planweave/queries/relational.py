"""Queries for the relations of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import operators as ops
from .. import sources as src
from .registry import Tables, query

c = F.col


@query("scan_table", "R1 E1", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t: Tables):
    return src.named_table(t.view("nation"), "nation")


@query("scan_parquet", "R2", "SELECT r_regionkey, r_name FROM region")
def _(t: Tables):
    return src.source(t.spark, "parquet", f"{t.folder}/region.parquet")


@query("scan_declared_schema", "R2", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000")
def _(t: Tables):
    return src.source(t.spark, "parquet", f"{t.folder}/orders.parquet", schema="o_orderkey bigint, o_totalprice double").where("o_totalprice > 400000")


_SQL = "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey"


@query("sql_escape", "R3", _SQL)
def _(t: Tables):
    return t.view("nation", "region").sql(_SQL)


@query("range", "R4", "SELECT CAST(range AS BIGINT) AS id FROM range(5, 100, 7)")
def _(t: Tables):
    return src.number_range(t.spark, 5, 100, 7)


@query("project", "R5 E4", "SELECT o_orderkey, o_totalprice * 2 AS twice, upper(o_orderpriority) AS p FROM orders")
def _(t: Tables):
    return t.orders.select("o_orderkey", (c("o_totalprice") * 2).alias("twice"), F.upper("o_orderpriority").alias("p"))


@query("filter", "R6 E2", "SELECT * FROM customer WHERE c_acctbal > 5000 AND c_mktsegment <> 'BUILDING'")
def _(t: Tables):
    return t.customer.where((c("c_acctbal") > 5000) & (c("c_mktsegment") != "BUILDING"))


_J = {
    "inner": ("inner", "JOIN"), "left": ("left", "LEFT JOIN"), "right": ("right", "RIGHT JOIN"), "full": ("full", "FULL JOIN"),
}
for _k, (_how, _join) in _J.items():

    @query(f"join_{_k}", "R7", f"SELECT c_custkey, o_orderkey FROM customer {_join} orders ON c_custkey = o_custkey AND o_totalprice > 30 * c_acctbal")
    def _(t: Tables, how=_how):
        return t.customer.join(t.orders, (c("c_custkey") == c("o_custkey")) & (c("o_totalprice") > 30 * c("c_acctbal")), how).select("c_custkey", "o_orderkey")


@query("join_semi", "R7", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(t: Tables):
    return t.customer.join(t.orders, (c("o_custkey") == c("c_custkey")) & (c("o_totalprice") > 300000), "left_semi").select("c_custkey", "c_name")


@query("join_anti", "R7", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def _(t: Tables):
    return t.customer.join(t.orders, (c("o_custkey") == c("c_custkey")) & (c("o_totalprice") > 100000), "left_anti").select("c_custkey", "c_name")


@query("join_cross", "R7", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def _(t: Tables):
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


@query("join_theta", "R7", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _(t: Tables):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (c("a.n_regionkey") == c("b.n_regionkey")) & (c("a.n_nationkey") < c("b.n_nationkey"))).select(c("a.n_name").alias("a"), c("b.n_name").alias("b"))


@query("agg_group", "R8", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty, max(l_shipdate) AS latest FROM lineitem GROUP BY ALL")
def _(t: Tables):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(c("l_quantity").cast("decimal(18,2)")).cast("double").alias("qty"), F.max("l_shipdate").alias("latest"))


@query("agg_global", "R8", "SELECT count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders")
def _(t: Tables):
    return t.orders.agg(F.count("*").alias("n"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))


@query("agg_count", "R8", "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1")
def _(t: Tables):
    return t.orders.groupBy("o_orderpriority").count()


@query("agg_distinct", "R8 E3", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def _(t: Tables):
    from ..functions import fn

    return t.orders.groupBy("o_orderstatus").agg(fn("count", c("o_custkey"), distinct=True).alias("customers"))


@query("sort", "R9", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey")
def _(t: Tables):
    return t.customer.select("c_custkey", "c_acctbal").orderBy(c("c_acctbal").desc_nulls_last(), "c_custkey")


@query("sort_limit_topk", "R9 R10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t: Tables):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(c("o_totalprice").desc(), "o_orderkey").limit(25)


@query("offset", "R11", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 7 OFFSET 11")
def _(t: Tables):
    return t.nation.select("n_nationkey", "n_name").orderBy("n_nationkey").offset(11).limit(7)


@query("tail", "R12", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 12")
def _(t: Tables):
    return ops.tail(t.orders.select("o_orderkey", "o_totalprice"), 12, ["o_totalprice", "o_orderkey"])


@query("distinct", "R13", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def _(t: Tables):
    return ops.dedup(t.customer.select("c_mktsegment", "c_nationkey"))


@query("drop_duplicates", "R13", "SELECT DISTINCT c_nationkey FROM customer")
def _(t: Tables):
    return ops.dedup(t.customer, "c_nationkey").select("c_nationkey")


@query("drop_columns", "R14", "SELECT s_suppkey, s_nationkey FROM supplier")
def _(t: Tables):
    return t.supplier.drop("s_name", "s_acctbal", "no_such_column")


_A, _B = "SELECT c_nationkey AS k FROM customer", "SELECT n_nationkey + n_regionkey FROM nation"
for _kind, _all in [(k, a) for k in ("union", "intersect", "except") for a in (False, True)]:

    @query(f"{_kind}{'_all' if _all else ''}", "R15", f"{_A} {_kind.upper()} {'ALL' if _all else ''} {_B}")
    def _(t: Tables, kind=_kind, all=_all):
        return ops.set_op(t.customer.select(c("c_nationkey").alias("k")), t.nation.select(c("n_nationkey") + c("n_regionkey")), kind, all)


@query("alias", "R16 E7", "SELECT n.* FROM nation n WHERE n.n_regionkey = 2")
def _(t: Tables):
    return t.nation.alias("n").where(c("n.n_regionkey") == 2).select("n.*")


@query("to_df", "R17", "SELECT r_regionkey AS id, r_name AS name FROM region")
def _(t: Tables):
    return t.region.toDF("id", "name")


@query("with_columns", "R18", "SELECT n_nationkey, n_name, n_regionkey + 1 AS n_regionkey, (n_regionkey + 1) * 10 AS ten FROM nation")
def _(t: Tables):
    return t.nation.withColumn("n_regionkey", c("n_regionkey") + 1).withColumn("ten", c("n_regionkey") * 10)


@query("rename", "R19", "SELECT n_nationkey AS id, n_name AS label, n_regionkey FROM nation")
def _(t: Tables):
    return t.nation.withColumnRenamed("n_nationkey", "key").withColumnRenamed("key", "id").withColumnsRenamed({"n_name": "label"})


@query("sample", "R20")
def _(t: Tables):
    return t.events.sample(withReplacement=False, fraction=0.1, seed=7)


@query("sample_by", "R29")
def _(t: Tables):
    return ops.sample_by(t.events, "event_type", {"click": 0.2, "error": 1.0}, 7)


@query("sample_bounds", "R20", "SELECT true AS near, true AS subset, true AS again")
def _(t: Tables):
    """The size is within six standard deviations, rows are rows of the table once each, the same seed gives the same rows."""
    some, again = t.events.sample(withReplacement=False, fraction=0.1, seed=7), t.events.sample(withReplacement=False, fraction=0.1, seed=7).select(c("event_id").alias("e"))
    whole = t.events.select(c("event_id").alias("k"), F.lit(1).alias("one"))
    sizes = some.join(whole, c("k") == c("event_id"), "full").join(again, c("e") == c("k"), "full").agg(F.count("event_id").alias("n"), F.count("k").alias("all"), (F.count(F.when(c("one").isNull(), 1)) == 0).alias("subset"), (F.count(F.when(c("event_id").isNull() != c("e").isNull(), 1)) == 0).alias("again"))
    return sizes.select((F.abs(c("n") - 0.1 * c("all")) <= 6 * F.sqrt(0.09 * c("all"))).alias("near"), "subset", "again")


@query("sample_by_bounds", "R29", "SELECT event_type, CASE event_type WHEN 'error' THEN count(*) END AS exact, true AS near FROM events WHERE event_type IN ('click', 'error') GROUP BY 1")
def _(t: Tables):
    """A stratum of fraction 1 is whole, one of 0.2 within six standard deviations, those without a fraction are absent."""
    kinds = t.events.groupBy("event_type").agg(F.count("*").alias("all"))
    some = ops.sample_by(t.events, "event_type", {"click": 0.2, "error": 1.0}, 7).groupBy("event_type").agg(F.count("*").alias("n"))
    share = F.when(c("event_type") == "click", 0.2).otherwise(1.0)
    near = F.abs(c("n") - share * c("all")) <= 6 * F.sqrt(share * (1 - share) * c("all"))
    return some.join(F.broadcast(kinds), "event_type").select("event_type", F.when(c("event_type") == "error", c("n")).alias("exact"), near.alias("near"))


@query("hint", "R21", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(t: Tables):
    return t.customer.join(t.nation.hint("broadcast"), c("c_nationkey") == c("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


_COUNTS = "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1"


@query("repartition", "R22", _COUNTS)
def _(t: Tables):
    return t.lineitem.select("l_returnflag").repartition(6).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("coalesce_partitions", "R22", _COUNTS)
def _(t: Tables):
    return t.lineitem.select("l_returnflag").coalesce(2).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("repartition_by", "R23", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def _(t: Tables):
    return t.orders.select("o_custkey").repartition("o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))


def _gaps(t: Tables):
    return t.events.select("event_id", F.when(c("event_id") % 3 != 0, c("value")).alias("v"), F.when(c("event_id") % 4 != 0, c("event_type")).alias("kind"))


_GAPS = "(SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS v, CASE WHEN event_id % 4 <> 0 THEN event_type END AS kind FROM events)"


@query("na_drop", "R24", f"SELECT * FROM {_GAPS} WHERE v IS NOT NULL AND kind IS NOT NULL")
def _(t: Tables):
    return _gaps(t).na.drop(subset=["v", "kind"])


@query("na_fill", "R25", f"SELECT event_id, coalesce(v, -1.0) AS v, coalesce(kind, 'none') AS kind FROM {_GAPS}")
def _(t: Tables):
    return _gaps(t).na.fill(-1.0, subset=["v"]).na.fill("none")


@query("na_replace", "R28", f"SELECT event_id, v, CASE kind WHEN 'click' THEN 'tap' WHEN 'view' THEN 'see' ELSE kind END AS kind FROM {_GAPS}")
def _(t: Tables):
    return _gaps(t).na.replace({"click": "tap", "view": "see"}, subset=["kind"])


@query("unpivot", "R26", "SELECT c_custkey, 'balance' AS what, c_acctbal AS amount FROM customer UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS DOUBLE) FROM customer")
def _(t: Tables):
    df = t.customer.select("c_custkey", c("c_acctbal").alias("balance"), c("c_nationkey").cast("double").alias("nation"))
    return df.unpivot("c_custkey", None, "what", "amount")


@query("transpose", "R27", "SELECT 'r_name' AS key, max(CASE r_regionkey WHEN 0 THEN r_name END) AS \"0\", max(CASE r_regionkey WHEN 1 THEN r_name END) AS \"1\", max(CASE r_regionkey WHEN 2 THEN r_name END) AS \"2\", max(CASE r_regionkey WHEN 3 THEN r_name END) AS \"3\", max(CASE r_regionkey WHEN 4 THEN r_name END) AS \"4\" FROM region")
def _(t: Tables):
    return t.region.transpose(c("r_regionkey"))


@query("approx_quantile", "R30", "SELECT [[quantile_disc(value, 0.25), quantile_disc(value, 0.5), quantile_disc(value, 0.9)]] AS approx_quantile FROM events")
def _(t: Tables):
    return ops.approx_quantile(t.events, ["value"], [0.25, 0.5, 0.9], 1e-6)


@query("observe", "R31", "SELECT event_id, value FROM events WHERE value > 10")
def _(t: Tables):
    return ops.observe(t.events.where("value > 10").select("event_id", "value"), "seen", F.count("*").alias("n"))[0]


def _sides(t: Tables):
    left = t.events.where("event_type = 'purchase'").select("user_id", "ts", c("event_id").alias("id"))
    right = t.events.where("event_type = 'view'").select("user_id", c("ts").alias("seen"), c("event_id").alias("view_id"))
    # one view a user and time
    return left, right.groupBy("user_id", "seen").agg(F.max("view_id").alias("view_id"))


_L = "(SELECT user_id, ts, event_id AS id FROM events WHERE event_type = 'purchase') l"
_R = "(SELECT user_id, ts AS seen, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) r"
for _name, _op, _args in [("backward", ">=", {}), ("forward", "<=", {"direction": "forward"}), ("strict", ">", {"allow_exact": False})]:

    @query(f"asof_{_name}", "R32", f"SELECT l.user_id, l.ts, l.id, r.seen, r.view_id FROM {_L} ASOF LEFT JOIN {_R} ON l.user_id = r.user_id AND l.ts {_op} r.seen")
    def _(t: Tables, args=_args):
        return ops.as_of_join(*_sides(t), "ts", "seen", by=["user_id"], **args)


@query("asof_tolerance", "R32", f"SELECT l.user_id, l.ts, l.id, CASE WHEN epoch_us(l.ts) - epoch_us(r.seen) <= 86400000000 THEN r.seen END AS seen, CASE WHEN epoch_us(l.ts) - epoch_us(r.seen) <= 86400000000 THEN r.view_id END AS view_id FROM {_L} ASOF LEFT JOIN {_R} ON l.user_id = r.user_id AND l.ts >= r.seen")
def _(t: Tables):
    return ops.as_of_join(*_sides(t), "ts", "seen", by=["user_id"], tolerance=86400)


@query("asof_nearest", "R32", f"SELECT user_id, ts, id, seen, view_id FROM (SELECT l.user_id, l.ts, l.id, r.seen, r.view_id, row_number() OVER (PARTITION BY l.id ORDER BY abs(epoch_us(l.ts) - epoch_us(r.seen)), r.seen) AS k FROM {_L} LEFT JOIN {_R} ON l.user_id = r.user_id) WHERE k = 1")
def _(t: Tables):
    return ops.as_of_join(*_sides(t), "ts", "seen", by=["user_id"], direction="nearest")


@query("asof_no_key", "R32", "SELECT l.id, l.ts, r.seen, r.view_id FROM (SELECT ts, event_id AS id FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT ts AS seen, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY 1) r ON l.ts >= r.seen")
def _(t: Tables):
    left = t.events.where("event_type = 'purchase'").select("ts", c("event_id").alias("id"))
    right = t.events.where("event_type = 'view'").groupBy(c("ts").alias("seen")).agg(F.max("event_id").alias("view_id"))
    return ops.as_of_join(left, right, "ts", "seen")


@query("lateral_join", "R33", "SELECT c.c_custkey, o.o_orderkey, o.o_totalprice FROM customer c, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c.c_custkey AND o_totalprice > 100000) o")
def _(t: Tables):
    inner = t.orders.where((c("o_custkey") == c("c.c_custkey").outer()) & (c("o_totalprice") > 100000)).select("o_orderkey", "o_totalprice")
    return ops.lateral_join(t.customer.alias("c"), inner).select("c_custkey", "o_orderkey", "o_totalprice")


@query("parse_json", "R34", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(t: Tables):
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("parse_json_inferred", "R34", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(t: Tables):
    return src.parse_text(t.events, "props", "json")


@query("parse_csv", "R34", "SELECT CAST(n_nationkey AS INTEGER) AS id, n_name AS name FROM nation")
def _(t: Tables):
    return src.parse_text(t.nation.select(F.concat_ws(",", "n_nationkey", "n_name").alias("line")), "line", "csv", "id int, name string")


@query("to_schema", "R35", "SELECT CAST(NULL AS VARCHAR) AS extra, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation")
def _(t: Tables):
    return ops.to_schema(t.nation, "extra string, n_nationkey bigint")


@query("local_empty", "R36", "SELECT CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS BIGINT) AS v WHERE false")
def _(t: Tables):
    return src.empty(t.spark, "ts timestamp_ntz, v bigint")


@query("inline_values", "R37", "SELECT * FROM (VALUES (CAST(1 AS INTEGER), CAST(2.5 AS DOUBLE), 'it''s'), (2, NULL, ''), (NULL, 4.0, 'a\\tb')) v(id, x, s)")
def _(t: Tables):
    return src.inline(t.spark, [(1, 2.5, "it's"), (2, None, ""), (None, 4, "a\\tb")], ["id", "x", "s"])


_LINE = "'+-----------+-----------+' || chr(10)"


@query("show_string", "R38", f"SELECT {_LINE} || '|r_regionkey|     r_name|' || chr(10) || {_LINE} || string_agg('|' || lpad(r_regionkey::VARCHAR, 11, ' ') || '|' || lpad(r_name, 11, ' ') || '|' || chr(10), '' ORDER BY r_regionkey) || {_LINE} AS show_string FROM region")
def _(t: Tables):
    return ops.show_string(t.region.orderBy("r_regionkey"))


@query("html_string", "R39", "SELECT '<table border=''1''>' || chr(10) || '<tr><th>r_regionkey</th><th>r_name</th></tr>' || chr(10) || string_agg('<tr><td>' || r_regionkey || '</td><td>' || r_name || '</td></tr>' || chr(10), '' ORDER BY r_regionkey) || '</table>' || chr(10) AS html_string FROM region")
def _(t: Tables):
    return ops.html_string(t.region.orderBy("r_regionkey"))


@query("tvf_explode", "R40", "SELECT unnest([3, 1, 2]) AS col")
def _(t: Tables):
    return src.table_function(t.spark, "explode(array(3, 1, 2))")


@query("catalog_current", "R41", "SELECT 'default' AS current_database")
def _(t: Tables):
    return src.catalog(t.spark.newSession(), "current_database")


@query("catalog_tables", "R41", "SELECT name FROM (VALUES ('nation'), ('region')) v(name)")
def _(t: Tables):
    return src.catalog(t.view("nation", "region"), "list_tables").where("isTemporary").select("name")


@query("describe", "R42", "SELECT unnest(['count', 'mean', 'stddev', 'min', 'max']) AS summary, round(unnest([count(value), avg(value), stddev_samp(value), min(value), max(value)]), 4) AS value FROM events")
def _(t: Tables):
    return t.events.describe("value").select("summary", F.round(c("value").cast("double"), 4).alias("value"))


@query("summary", "R43", "SELECT unnest(['count', 'min', 'near', 'max']) AS summary, unnest([count(value), min(value), 1, max(value)]) AS value FROM events")
def _(t: Tables):
    found = t.events.select("value").summary("count", "min", "50%", "max").select("summary", c("value").cast("double").alias("value"))
    # the median is approximate: near tells whether its rank is within a hundredth of the middle
    bounds = t.events.agg(F.percentile("value", F.array(F.lit(0.49), F.lit(0.51))).alias("p"))
    near = found.where("summary = '50%'").crossJoin(F.broadcast(bounds)).select(F.lit("near").alias("summary"), c("value").between(c("p")[0], c("p")[1]).cast("double").alias("value"))
    return found.where("summary <> '50%'").union(near)


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("crosstab", "R44", "SELECT o_orderstatus AS o_orderstatus_o_orderpriority, " + ", ".join(f"count(*) FILTER (o_orderpriority = '{x}') AS \"{x}\"" for x in _PRIORITIES) + " FROM orders GROUP BY 1")
def _(t: Tables):
    return t.orders.crosstab("o_orderstatus", "o_orderpriority")


@query("cov", "R45", "SELECT round(covar_samp(l_quantity, l_extendedprice), 4) AS cov FROM lineitem")
def _(t: Tables):
    return ops.cov(t.lineitem, "l_quantity", "l_extendedprice").select(F.round("cov", 4).alias("cov"))


@query("corr", "R46", "SELECT round(corr(l_quantity, l_extendedprice), 8) AS corr FROM lineitem")
def _(t: Tables):
    return ops.corr(t.lineitem, "l_quantity", "l_extendedprice").select(F.round("corr", 8).alias("corr"))


@query("freq_items", "R47", "SELECT list_sort(list(DISTINCT event_type)) AS event_type_freqItems FROM events")
def _(t: Tables):
    # fewer kinds than the ten counters of this support: none is lost
    return t.events.freqItems(["event_type"], 0.1).select(F.sort_array("event_type_freqItems").alias("event_type_freqItems"))


@query("cube", "R8", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(t: Tables):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("rollup", "R8", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(t: Tables):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("union_by_name", "R15", "SELECT s_nationkey AS k, s_name AS name FROM supplier UNION ALL SELECT n_nationkey, n_name FROM nation")
def _(t: Tables):
    return t.supplier.select(c("s_nationkey").alias("k"), c("s_name").alias("name")).unionByName(t.nation.select(c("n_name").alias("name"), c("n_nationkey").alias("k")))
