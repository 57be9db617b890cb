"""AUTO CDC, SCD type 1: change rows of a stream become one current row for each key, without a merging table format.

The state keeps a row for each key: the sequence that set each column, and the sequence of its last delete. A delete
stays as a tombstone, so that a late older change can't bring a row back. Results depend on the changes alone, not on
their order or batches, if sequences of a key differ; equal sequences go to the larger values.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from ..plans.model import AutoCdc

_ROW, _DELETE = "__row", "__delete"
#: The state's partition column: a batch rewrites the buckets that its keys are in.
BUCKET = "__bucket"


def bucket(f: AutoCdc, number: int) -> Column:
    return F.pmod(F.xxhash64(*f.keys), F.lit(number)).cast("int")


def payload(columns: list[str], f: AutoCdc) -> list[str]:
    if f.columns is not None:
        return [c for c in columns if c in f.columns or c in f.keys]
    return [c for c in columns if c not in f.except_columns or c in f.keys]


def target_schema(source: DataFrame, f: AutoCdc) -> T.StructType:
    """The target's columns; names and conditions that don't resolve are analysis errors."""
    source.select(*f.keys, F.expr(f.sequence_by), *(F.expr(x).cast("boolean") for x in (f.apply_as_deletes, f.apply_as_truncates) if x))
    return source.select(*payload(source.columns, f)).schema


def _kept(f: AutoCdc, c: str) -> bool:
    """Whether a null of the column keeps the value before."""
    return c not in f.keys and (f.ignore_null_updates is True or (not isinstance(f.ignore_null_updates, bool) and c in f.ignore_null_updates))


def changes(batch: DataFrame, f: AutoCdc) -> tuple[DataFrame, DataFrame]:
    """(upserts and deletes, truncates) of a batch: keys, __seq, __delete, __row."""
    delete = F.coalesce(F.expr(f.apply_as_deletes).cast("boolean"), F.lit(False)) if f.apply_as_deletes else F.lit(False)
    truncate = F.coalesce(F.expr(f.apply_as_truncates).cast("boolean"), F.lit(False)) if f.apply_as_truncates else F.lit(False)
    rows = batch.select(*f.keys, F.expr(f.sequence_by).alias("__seq"), delete.alias(_DELETE), truncate.alias("__truncate"), F.struct(*payload(batch.columns, f)).alias(_ROW)).where("__seq is not null")
    return rows.where("not __truncate").drop("__truncate"), rows.where("__truncate").select("__seq")


def reduce(rows: DataFrame, f: AutoCdc, columns: list[str]) -> DataFrame:
    """One row a key: the last delete, the last upsert, and by column the last upsert that sets it. Partially aggregated, in any order."""
    up = ~F.col(_DELETE)
    seq = F.col("__seq")
    aggs: list[Column] = [F.max(F.when(F.col(_DELETE), seq)).alias("__gone"), F.max(F.when(up, seq)).alias("__set")]
    for c in columns:
        if c not in f.keys:
            value = F.col(_ROW)[c]
            fine = up & value.isNotNull() if _kept(f, c) else up
            aggs.append(F.max(F.when(fine, F.struct(seq.alias("seq"), value.alias("value")))).alias(c))
    return rows.groupBy(*f.keys).agg(*aggs)


def merged(state: DataFrame, new: DataFrame, f: AutoCdc, columns: list[str]) -> DataFrame:
    """State and a batch's reduction as one state: every column's later setting, every key's later delete."""
    rest = [c for c in columns if c not in f.keys]
    return state.unionByName(new).groupBy(*f.keys).agg(F.max("__gone").alias("__gone"), F.max("__set").alias("__set"), *[F.max(c).alias(c) for c in rest])


def truncated(state: DataFrame, last: Column) -> DataFrame:
    """A truncate is a delete of every key at its sequence; keys that nothing has set since stay as tombstones."""
    return state.withColumn("__gone", F.greatest("__gone", last))


def current(state: DataFrame, f: AutoCdc, columns: list[str]) -> DataFrame:
    """The target: keys whose last upsert is later than their last delete; values set before that delete are null again."""
    alive = F.col("__set").isNotNull() & (F.col("__gone").isNull() | (F.col("__set") > F.col("__gone")))
    value = lambda c: F.when(F.col("__gone").isNull() | (F.col(c)["seq"] > F.col("__gone")), F.col(c)["value"])
    return state.where(alive).select(*[F.col(c) if c in f.keys else value(c).alias(c) for c in columns])
