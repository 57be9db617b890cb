"""URL filters by sort-merge range joins: canonical keys turn prefixes into intervals, a sorted sweep keeps the open rules.

DataFrame functions alone: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Order of events with equal keys. A byte that no UTF-8 text holds ends the interval of a prefix.
_CLOSE, _OPEN, _POINT = 0, 1, 2
#: Hosts with rules that are broadcast at most.
BROADCAST = 200_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)).otherwise(None)
    rest = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without a host part."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)).otherwise(None)
    rest = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """Labels from the last to the first, each with a dot after it: a host's subdomains are what begins with its key."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def sweep(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """(key, level, rule): for each different key of points (key string) the intervals (prefix string, rule) open there.

    level 1 is the shortest prefix, the largest level the longest. Prefixes must differ. Points and the ends of
    intervals are dealt to ranges of the sorted keys. The number of ends before a row gives its depth; the rule
    open at a level is the last one that opened at this depth, in this range or before it. Keys outside every
    interval give no row. Nulls give no row. No range holds a key twice, so none grows with repeated keys.
    """
    binary = lambda c: F.col(c).cast("binary")
    none = F.lit(None).cast(dict(intervals.dtypes)["rule"])
    events = points.where("key is not null").select(binary("key").alias("k"), F.lit(_POINT).alias("kind"), none.alias("rule")).distinct()
    events = events.union(intervals.where("prefix is not null").select(binary("prefix"), F.lit(_OPEN), "rule"))
    events = events.union(intervals.where("prefix is not null").select(F.concat(binary("prefix"), F.lit(b"\xff")), F.lit(_CLOSE), none))
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    events = cut(events.repartitionByRange(parts, "k", "kind").withColumn("part", F.spark_partition_id()))
    change = F.when(F.col("kind") == _OPEN, 1).when(F.col("kind") == _CLOSE, -1).otherwise(0)

    # one row a range: how many rules are open when it begins
    begins = events.groupBy("part").agg(F.sum(change).alias("change"))
    begins = begins.select("part", F.coalesce(F.sum("change").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    deep = events.join(F.broadcast(begins), "part").withColumn("depth", F.col("before") + F.sum(change).over(Window.partitionBy("part").orderBy("k", "kind").rowsBetween(Window.unboundedPreceding, 0)))
    deep = cut(deep.drop("before"))
    opened = deep.where(F.col("kind") == _OPEN).select("part", "k", "kind", F.col("depth").alias("level"), "rule")

    # what each range takes over, by level
    last = opened.groupBy("part", "level").agg(F.max_by("rule", "k").alias("last"))
    grid = begins.where("before > 0").select("part", F.explode(F.sequence(F.lit(1).cast("long"), F.col("before"))).alias("level"))
    taken = grid.join(last, ["part", "level"], "full").withColumn("rule", F.last("last", ignorenulls=True).over(Window.partitionBy("level").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    taken = taken.where("rule is not null").select("part", F.lit(b"").alias("k"), F.lit(-1).alias("kind"), "level", "rule")

    at = deep.where((F.col("kind") == _POINT) & (F.col("depth") > 0)).select("part", "k", "kind", F.explode(F.sequence(F.lit(1).cast("long"), F.col("depth"))).alias("level"), "rule")
    stack = Window.partitionBy("part", "level").orderBy("k", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = taken.union(opened).union(at).withColumn("rule", F.last("rule", ignorenulls=True).over(stack))
    return found.where(F.col("kind") == _POINT).select(F.col("k").cast("string").alias("key"), "level", "rule")


def rules_of(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(host, path, verdict) of ("block", "example.org/path") pairs."""
    rows = [(h.lower(), slash + p, verdict) for verdict, text in rules for h, slash, p in [text.partition("/")]]
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    A rule (host, path, verdict) fits its host and all subdomains where the url's path begins with the rule's;
    the longest wins, by host, then by path. Without one, rule is null and verdict the default. Of rules with
    equal host and path a block counts. A null url, or one without ://, has an empty host and path. Repeated rows
    and null ids are kept; no rules or no pages are fine. Each different host, and each different path under a
    rule's host, is swept once, however many rows have it.
    """
    rules = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    given = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    places = cut(given.where("host <> ''").groupBy("host", "path").agg(F.lit(1).alias("n")).select("host", "path"))

    hosts = places.select("host").distinct().withColumn("key", reversed_host(F.col("host")))
    owners = sweep(hosts.select("key"), rules.select("host").distinct().select(reversed_host(F.col("host")).alias("prefix"), F.col("host").alias("rule")))
    owners = cut(hosts.join(owners, "key").select("host", F.col("rule").alias("rule_host")))
    few = owners.count() <= BROADCAST

    under = lambda host, path: F.concat(reversed_host(host), F.lit("\n"), path)  # noqa: E731  rules have no line end in a host
    # a host of many paths goes nowhere where its rules come to all tasks; else adaptive joins split it
    near = places.join(F.broadcast(owners) if few else owners, "host").withColumn("key", under(F.col("rule_host"), F.col("path")))
    fits = sweep(near.select("key"), rules.select(under(F.col("host"), F.col("path")).alias("prefix"), F.struct("host", "path", "verdict").alias("rule")))
    longest = fits.groupBy("key").agg(F.max_by("rule", "level").alias("rule"))
    best = near.join(longest, "key").groupBy("host", "path").agg(F.max_by("rule", F.struct(F.length("rule_host"), F.col("rule_host"))).alias("best"))

    # rows without a host fit no rule and stay out of the join
    bare = given.where("host = ''").withColumn("best", F.lit(None).cast(dict(best.dtypes)["best"]))
    out = given.where("host <> ''").join(best, ["host", "path"], "left").unionByName(bare)
    return out.select("page_id", "host", "path", F.concat("best.host", "best.path").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
