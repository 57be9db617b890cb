"""Leaves of a query: named tables, any source format, SQL, ranges, inline rows, table functions, the catalog."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Sources that fix their schema themselves and reject a declared one.
FIXED_SCHEMA = frozenset({"rate", "rate-micro-batch", "socket"})
#: Limits of an inline table: rows, and bytes as estimated by inline_bytes.
INLINE_ROWS, INLINE_BYTES = 1000, 64 * 1024


def named_table(spark: SparkSession, name: str, streaming: bool = False) -> DataFrame:
    return spark.readStream.table(name) if streaming else spark.table(name)


def source(spark: SparkSession, format: str, path: str | None = None, schema: str | T.StructType | None = None, streaming: bool = False, **options: Any) -> DataFrame:
    """Any source by its format; a declared schema is withheld from the sources that reject one."""
    reader = (spark.readStream if streaming else spark.read).format(format).options(**options)
    if schema is not None and format.lower() not in FIXED_SCHEMA:
        reader = reader.schema(schema)
    return reader.load(path) if path is not None else reader.load()


def number_range(spark: SparkSession, start: int, end: int | None = None, step: int = 1) -> DataFrame:
    return spark.range(0, start, 1) if end is None else spark.range(start, end, step)


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


class InlineTableTooLarge(ValueError):
    """More rows or bytes than an inline table may have."""


def inline_bytes(rows: Sequence[Sequence[Any]]) -> int:
    """Characters of strings, nothing for null, 8 for anything else."""
    return sum(len(c) if isinstance(c, str) else 0 if c is None else 8 for row in rows for c in row)


def _type_of(cells: Sequence[Any], column: str) -> T.DataType:
    kinds = {bool if isinstance(c, bool) else type(c) for c in cells if c is not None}
    if not kinds:
        raise ValueError(f"column {column}: all cells are null, so it has no type")
    if kinds == {bool}:
        return T.BooleanType()
    if kinds == {str}:
        return T.StringType()
    if kinds <= {int, float}:
        if float in kinds:
            return T.DoubleType()
        wide = any(not -(2**31) <= c < 2**31 for c in cells if c is not None)
        return T.LongType() if wide else T.IntegerType()
    raise ValueError(f"column {column}: mixed kinds {sorted(k.__name__ for k in kinds)}")


def inline(spark: SparkSession, rows: Sequence[Any], names: Sequence[str] | None = None) -> DataFrame:
    """A literal table. Numbers widen (int, long, double), nulls take their siblings' type; names default to _1, _2, ...

    At least one row, equal widths, at most INLINE_ROWS rows and INLINE_BYTES bytes. Strings, NaN and infinities
    keep their values exactly.
    """
    if not rows:
        raise ValueError("an inline table needs a row")
    cells = [tuple(r) if isinstance(r, (tuple, list)) else (r,) for r in rows]
    width = len(cells[0])
    if any(len(r) != width for r in cells):
        raise ValueError("rows of an inline table have different widths")
    names = list(names) if names is not None else [f"_{k + 1}" for k in range(width)]
    if len(names) != width:
        raise ValueError(f"{len(names)} names for {width} columns")
    if len(cells) > INLINE_ROWS or (size := inline_bytes(cells)) > INLINE_BYTES:
        raise InlineTableTooLarge(f"{len(cells)} rows; at most {INLINE_ROWS}" if len(cells) > INLINE_ROWS else f"{size} bytes; at most {INLINE_BYTES}")
    kinds = [_type_of([r[k] for r in cells], names[k]) for k in range(width)]
    cells = [tuple(float(c) if isinstance(t, T.DoubleType) and c is not None else c for c, t in zip(r, kinds)) for r in cells]
    return spark.createDataFrame(cells, T.StructType([T.StructField(n, t) for n, t in zip(names, kinds)]))


def table_function(spark: SparkSession, call: str) -> DataFrame:
    """A table-valued function by its SQL call, such as explode(array(1, 2))."""
    return spark.sql(f"SELECT * FROM {call}")


def catalog(spark: SparkSession, what: str, database: str | None = None) -> DataFrame:
    """current_database, list_databases or list_tables as a relation."""
    if what == "current_database":
        return spark.createDataFrame([(spark.catalog.currentDatabase(),)], "current_database string")
    if what == "list_databases":
        return spark.createDataFrame([(d.name, d.catalog, d.description, d.locationUri) for d in spark.catalog.listDatabases()], "name string, catalog string, description string, locationUri string")
    if what == "list_tables":
        return spark.createDataFrame([(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables(database)], "name string, tableType string, isTemporary boolean")
    raise ValueError(f"no catalog operation {what!r}")


def parse_text(df: DataFrame, column: str, format: str, schema: str | None = None, options: Mapping[str, str] | None = None) -> DataFrame:
    """One text column read as json or csv. Without a schema it is inferred from the column; rows that don't parse give nulls."""
    if format not in ("json", "csv"):
        raise ValueError(f"can't parse {format!r}")
    from pyspark.sql import functions as F

    options = dict(options or {})
    if schema is None:
        lines = df.select(F.col(column).cast("string").alias("value")).where("value is not null")
        strings = getattr(lines._jdf, "as")(df.sparkSession._jvm.org.apache.spark.sql.Encoders.STRING())
        inferred = getattr(df.sparkSession.read.options(**options)._jreader, format)(strings)
        schema = inferred.schema().toDDL()
    read = F.from_json(column, schema, options) if format == "json" else F.from_csv(column, schema, options)
    return df.select(read.alias("parsed")).select("parsed.*")
