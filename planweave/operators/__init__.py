"""Relations that the DataFrame API lacks or returns as values: tail, quantiles, covariance, rendered tables, metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .asof import as_of_join

__all__ = ["approx_quantile", "as_of_join", "corr", "cov", "dedup", "html_string", "lateral_join", "observe", "sample_by", "set_op", "show_string", "tail", "to_schema"]


#: Rows that tail without an order brings to the driver at most.
TAIL = 100_000


def tail(df: DataFrame, n: int, order: Sequence[tuple[str, str] | str] = ()) -> DataFrame:
    """The last n rows as a relation.

    With an order (names, or pairs of a name and asc or desc) it is a top-k in reverse, which stays on the
    executors. Without one it is what df.tail(n) collects: n rows through the driver, TAIL at most.
    """
    if not order:
        if n > TAIL:
            raise ValueError(f"the last {n} rows without an order go through the driver, which takes {TAIL}; name an order")
        return df.sparkSession.createDataFrame(df.tail(n), df.schema)
    keys = [(k, "asc") if isinstance(k, str) else k for k in order]
    forth = [F.col(k).desc_nulls_last() if d == "desc" else F.col(k).asc_nulls_first() for k, d in keys]
    back = [F.col(k).asc_nulls_first() if d == "desc" else F.col(k).desc_nulls_last() for k, d in keys]
    return df.orderBy(*back).limit(n).orderBy(*forth)


def set_op(left: DataFrame, right: DataFrame, kind: str, all: bool = False) -> DataFrame:
    """union, intersect or except by position; the left side names the columns."""
    if kind == "union":
        return left.union(right) if all else left.union(right).distinct()
    if kind == "intersect":
        return left.intersectAll(right) if all else left.intersect(right)
    if kind == "except":
        return left.exceptAll(right) if all else left.subtract(right)
    raise ValueError(f"no set operation {kind!r}")


def dedup(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropDuplicates(list(columns)) if columns else df.distinct()


def approx_quantile(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], error: float = 1e-4) -> DataFrame:
    """One row with the column approx_quantile: for each column the quantiles asked for.

    A partial aggregate whose state grows with 1 / error, not with the rows. A rank is wrong by error * rows at most; nulls
    are left out, a column without values gives null.
    """
    if not 0 < error < 1:
        raise ValueError(f"error {error} is not between 0 and 1")
    found = [F.percentile_approx(F.col(c).cast("double"), list(probabilities), int(round(1 / error))) for c in columns]
    return df.agg(F.array(*found).alias("approx_quantile"))


def cov(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.covar_samp(a, b).alias("cov"))


def corr(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.corr(a, b).alias("corr"))


def sample_by(df: DataFrame, column: str, fractions: Mapping[Any, float], seed: int | None = None) -> DataFrame:
    return df.sampleBy(column, dict(fractions), seed)


def to_schema(df: DataFrame, schema: str | T.StructType) -> DataFrame:
    """The declared columns, in order; a name that df lacks is an all-null column."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    return df.to(schema)


def show_string(df: DataFrame, rows: int = 20, truncate: int = 20, vertical: bool = False) -> DataFrame:
    """The table that show() prints, as one string cell."""
    return df.sparkSession.createDataFrame([(df._jdf.showString(rows, truncate, vertical),)], "show_string string")


def html_string(df: DataFrame, rows: int = 20, truncate: int = 20) -> DataFrame:
    return df.sparkSession.createDataFrame([(df._jdf.htmlString(rows, truncate),)], "html_string string")


def observe(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, Observation | None]:
    """df with named metrics on the way; the Observation is None for streams, whose listener gets them."""
    if df.isStreaming:
        return df.observe(name, *metrics), None
    seen = Observation(name)
    return df.observe(seen, *metrics), seen


def lateral_join(left: DataFrame, right: DataFrame, on: Column | None = None, how: str = "inner") -> DataFrame:
    return left.lateralJoin(right, on, how)
