"""Queries that run whole pipelines: dataset declarations, streams, once flows and change data capture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import Pipeline, Runner
from ..session import scratch
from .registry import Tables, query

c = F.col


def _result(t: Tables, p: Pipeline, name: str, runs: int = 1) -> DataFrame:
    """Runs the pipeline in a new storage root and reads one of its datasets."""
    runner = Runner(t.spark, p, scratch(t.spark, "run"), timeout=None)
    for _ in range(runs):
        runner.run()
    return runner.resolve(name, False)


def _events(t: Tables, p: Pipeline) -> None:
    """events as something that can be read as a batch and as a stream: a copy in a folder of its own."""
    path = scratch(t.spark, "events")
    t.events.write.parquet(path)
    p.external("events", path)


def _tables(t: Tables, p: Pipeline, *names: str) -> None:
    for n in names:
        p.external(n, f"{t.folder}/{n}.parquet")


@query("pricing_summary", "D1 D4 D12 R8", """
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
""")
def pricing_summary(t: Tables):
    p = Pipeline()
    _tables(t, p, "lineitem")

    @p.materialized_view()
    def summary(spark):
        exact = lambda x: F.sum(c(x).cast("decimal(18,2)")).cast("double")
        return (
            spark.table("lineitem").where(c("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus")
            .agg(exact("l_quantity").alias("sum_qty"), exact("l_extendedprice").alias("sum_base_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"))
        )

    return _result(t, p, "summary")


@query("batch_table", "D2 D3", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def _(t: Tables):
    p = Pipeline()
    _tables(t, p, "nation", "region")
    p.declare_table("names")

    @p.append_flow("names")
    def of_nations(spark):
        return spark.table("nation").select(c("n_name").alias("name"))

    @p.append_flow("names")
    def of_regions(spark):
        return spark.table("region").select(c("r_name").alias("name"))

    @p.table()
    def copied(spark):
        return spark.table("names")

    return _result(t, p, "copied")


@query("sql_datasets", "D6 D7", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(t: Tables):
    p = Pipeline()
    _tables(t, p, "nation", "region")
    p.materialized_view_sql("by_region", "SELECT r_name, count(*) AS n FROM joined GROUP BY r_name")
    p.temporary_view_sql("joined", "WITH r AS (SELECT * FROM region) SELECT r_name, n_name FROM nation JOIN r ON n_regionkey = r_regionkey")
    return _result(t, p, "by_region")


@query("stream_filter", "D5", "SELECT event_id, user_id, value FROM events WHERE value > 20")
def _(t: Tables):
    p = Pipeline()
    _events(t, p)

    @p.streaming_table()
    def large(spark):
        return spark.readStream.table("events").where("value > 20").select("event_id", "user_id", "value")

    return _result(t, p, "large", runs=2)


@query("stream_static_join", "D5 R7", "SELECT event_id, n_name FROM events JOIN nation ON user_id % 25 = n_nationkey")
def _(t: Tables):
    p = Pipeline()
    _events(t, p)
    _tables(t, p, "nation")

    @p.streaming_table()
    def placed(spark):
        return spark.readStream.table("events").join(spark.table("nation"), c("user_id") % 25 == c("n_nationkey")).select("event_id", "n_name")

    return _result(t, p, "placed")


@query("stream_dedup", "D5 R13", "SELECT DISTINCT user_id FROM events")
def _(t: Tables):
    p = Pipeline()
    _events(t, p)

    @p.streaming_table()
    def users(spark):
        return spark.readStream.table("events").select("user_id").dropDuplicates(["user_id"])

    return _result(t, p, "users")


@query("stream_sql", "D8", "SELECT event_id, upper(event_type) AS kind FROM events WHERE event_type <> 'view'")
def _(t: Tables):
    p = Pipeline()
    _events(t, p)
    p.streaming_table_sql("kinds", "SELECT event_id, upper(event_type) AS kind FROM STREAM(events) WHERE event_type <> 'view'")
    return _result(t, p, "kinds")


@query("once_flow", "D11 D9", "SELECT event_id FROM events UNION ALL SELECT -event_id FROM events")
def _(t: Tables):
    p = Pipeline()
    _events(t, p)
    p.create_streaming_table("ids")

    @p.append_flow("ids")
    def live(spark):
        return spark.readStream.table("events").select("event_id")

    @p.append_flow("ids", once=True)
    def backfill(spark):
        return spark.table("events").select((-c("event_id")).alias("event_id"))

    return _result(t, p, "ids", runs=2)


@query("cdc_scd1", "D9 D10", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1 AND event_type <> 'error'")
def _(t: Tables):
    p = Pipeline()
    _events(t, p)
    p.create_streaming_table("latest")
    p.create_auto_cdc_flow("latest", "events", ["user_id"], "event_id", apply_as_deletes="event_type = 'error'", column_list=["user_id", "event_id", "event_type", "value"])
    return _result(t, p, "latest", runs=2)
