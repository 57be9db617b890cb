"""As-of join: the nearest right row of each left row, by one sort of both sides together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

DIRECTIONS = ("backward", "forward", "nearest")


def as_of_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: Sequence[str] = (), direction: str = "backward", allow_exact: bool = True, tolerance: float | None = None, how: str = "left", suffix: str = "_right") -> DataFrame:
    """Each left row with the right row whose `right_on` is nearest to its `left_on` in the direction.

    Both sides are tagged, united and sorted by `by` and time once (no inequality join): a window carries the last
    right row forward (backward) or the next one back (forward); nearest takes the closer, a tie goes backward.
    Of right rows with equal times the one that is largest by all its columns counts, so results are
    deterministic. Null times and null keys never match; left rows without a match stay with nulls (how="left")
    or go (how="inner"). tolerance is the largest distance, in units of the time, seconds for timestamps, days for
    dates. Right columns whose names the left side has get the suffix; the keys are not repeated. Rows are dealt to
    ranges of keys and time, and a range takes over the last row before it of the key that it begins with, so no task
    gets all rows, nor all of one key. Timestamps without a zone are compared as they are written, whatever the
    session's zone.
    """
    if direction not in DIRECTIONS or how not in ("left", "inner"):
        raise ValueError(f"direction {direction!r}, how {how!r}")
    spare = [c for c in right.columns if c not in by]
    names = {c: c + suffix if c in left.columns else c for c in spare}
    time = lambda df, c: _number(df, c)
    l = left.select(F.struct(*[F.col(c) for c in left.columns]).alias("l"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], time(left, left_on).alias("t"), F.lit(True).alias("is_left"))  # noqa: E741
    r = right.where(F.col(right_on).isNotNull())
    for c in by:
        r = r.where(F.col(c).isNotNull())
    r = r.select(F.struct(time(right, right_on).alias("t"), F.struct(*[F.col(c) for c in spare]).alias("row")).alias("r"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], time(right, right_on).alias("t"), F.lit(False).alias("is_left"))
    both = l.unionByName(r, allowMissingColumns=True)
    keys = [f"k{i}" for i in range(len(by))]
    looks = {"backward": ("backward",), "forward": ("forward",), "nearest": DIRECTIONS[:2]}[direction]
    both = _ranged(both, looks, allow_exact, keys)
    if tolerance is not None and dict(left.dtypes)[left_on].startswith("timestamp"):
        tolerance = round(tolerance * 1_000_000)
    out = both.where("is_left")
    for look in looks:
        found = F.col(look)
        fine = F.col("t").isNotNull() & found.isNotNull()
        for k in keys:
            fine = fine & F.col(k).isNotNull()
        if tolerance is not None:
            fine = fine & (F.abs(F.col("t") - found["t"]) <= F.lit(tolerance))
        out = out.withColumn(look, F.when(fine, found))
    if direction == "nearest":
        b, f = F.col("backward"), F.col("forward")
        match = F.when(b.isNull() | (f.isNotNull() & (f["t"] - F.col("t") < F.col("t") - b["t"])), f).otherwise(b)
    else:
        match = F.col(direction)
    out = out.withColumn("m", match)
    if how == "inner":
        out = out.where("m is not null")
    return out.select(*[F.col("l")[c].alias(c) for c in left.columns], *[F.col("m")["row"][c].alias(names[c]) for c in spare])


def _number(df: DataFrame, c: str) -> Column:
    """Times as numbers: microseconds, without a zone those of the time as it is written; days; anything else as it is."""
    kind = dict(df.dtypes)[c]
    if kind == "timestamp_ntz":
        time = F.col(c)
        seconds = (F.unix_date(time.cast("date")) * 24 + F.hour(time)) * 3600 + F.minute(time) * 60
        return seconds.cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("long")
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind == "date":
        return F.unix_date(c)
    return F.col(c)


def _order(look: str, allow_exact: bool) -> list[Column]:
    """Right rows come before the left rows of the same time if those may match them."""
    side = F.col("is_left").cast("int")
    if look == "backward":
        return [F.col("t").asc(), side.asc() if allow_exact else side.desc(), F.col("r").asc_nulls_first()]
    return [F.col("t").desc(), side.asc() if allow_exact else side.desc(), F.col("r").asc_nulls_first()]


def _seen(look: str, allow_exact: bool, keys: Sequence[str]) -> Column:
    w = Window.partitionBy(*keys).orderBy(*_order(look, allow_exact)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last("r", ignorenulls=True).over(w)


def _ranged(both: DataFrame, looks: Sequence[str], allow_exact: bool, keys: Sequence[str]) -> DataFrame:
    parts = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = cut(both.repartitionByRange(parts, *keys, "t").withColumn("part", F.spark_partition_id()))
    held = both
    if keys:
        # ranges are sorted: only the key that a range begins with can have rows in one before it
        first = both.groupBy("part").agg(F.min(F.struct(*keys)).alias("k")).select("k.*").distinct()  # one row a range at most
        held = both.join(F.broadcast(first), list(keys))
    own = ["part", *keys]
    spans = held.select(own).distinct()  # about two rows a range at most
    for look in looks:
        rights = held.where("not is_left")
        if look == "forward":
            nearest = rights.groupBy(own).agg(F.min("t").alias("t"))
            rights = rights.join(F.broadcast(nearest), [*own, "t"])
        ends = rights.groupBy(own).agg(F.max("r").alias("end"))
        order = Window.partitionBy(*keys).orderBy(F.col("part").asc() if look == "backward" else F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
        taken = spans.join(ends, own, "left").select(*own, F.last("end", ignorenulls=True).over(order).alias("taken"))
        both = both.join(F.broadcast(taken), own, "left").withColumn(look, F.coalesce(_seen(look, allow_exact, own), "taken")).drop("taken")
    return both
