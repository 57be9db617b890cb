"""Functions by name: the built-in library, operators under their names, and distinct aggregates."""

from __future__ import annotations

from typing import Any

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

#: Operators by name; Spark's function registry does not resolve all of them.
OPERATORS = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "%": lambda a, b: a % b,
    ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b, "!=": lambda a, b: ~(a == b), "and": lambda a, b: a & b, "or": lambda a, b: a | b,
}
_DISTINCT = {"count": F.count_distinct, "sum": F.sum_distinct}


def _column(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def fn(name: str, *args: Any, distinct: bool = False) -> Column:
    """Any Spark SQL function or operator by name; arguments that aren't columns are literals."""
    columns = [_column(a) for a in args]
    if distinct:
        if name in _DISTINCT:
            return _DISTINCT[name](*columns)
        return call_distinct(name, *columns)
    if name in OPERATORS:
        return OPERATORS[name](*columns)
    if name == "in":
        first, *rest = columns
        out = F.lit(False)
        for c in rest:
            out = out | (first == c)
        return out
    if name == "when":
        out, pairs = F, columns
        while len(pairs) > 1:
            out, pairs = out.when(pairs[0], pairs[1]), pairs[2:]
        return out.otherwise(pairs[0]) if pairs else out
    return F.call_function(name, *columns)


def call_distinct(name: str, *columns: Column) -> Column:
    """An aggregate over the different values of its columns, as DISTINCT in SQL: planned as partial aggregates."""
    jvm = SparkContext._active_spark_context._jvm  # type: ignore[union-attr]
    nodes = jvm.PythonUtils.toSeq([c._jc.node() for c in columns])
    origin = jvm.org.apache.spark.sql.catalyst.trees.CurrentOrigin.get()
    return ClassicColumn(jvm.org.apache.spark.sql.Column(jvm.org.apache.spark.sql.internal.UnresolvedFunction(name, nodes, True, False, False, origin)))


#: The named library, as it is called here; everything else goes through fn().
NAMES = {
    "aggregates": "count sum avg mean min max first last collect_list collect_set",
    "windows": "row_number rank dense_rank ntile lag lead",
    "strings": "upper lower trim length concat concat_ws substring split regexp_replace",
    "dates": "to_date to_timestamp date_trunc year month dayofmonth hour minute second current_date current_timestamp date_add date_sub datediff",
    "math": "abs round floor ceil sqrt pow exp log greatest least",
    "nulls": "coalesce isnull isnan when",
    "complex": "struct array create_map explode explode_outer size element_at array_contains map_keys map_values",
    "higher_order": "transform filter forall aggregate zip_with",
    "misc": "hash md5 sha2 monotonically_increasing_id rand",
}


def __getattr__(name: str) -> Any:
    if any(name in names.split() for names in NAMES.values()):
        return getattr(F, name)
    if name == "map_":
        return F.create_map
    raise AttributeError(name)
