"""The dataset graph: datasets, the flows that fill them, and what can be wrong with them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame


class Kind(str, Enum):
    EXTERNAL = "external"
    TABLE = "table"
    STREAMING_TABLE = "streaming_table"
    MATERIALIZED_VIEW = "materialized_view"
    TEMPORARY_VIEW = "temporary_view"


Body = Callable[[Any], DataFrame]


@dataclass(frozen=True)
class Dataset:
    """A node. An external one is read from `path` (any `format`) or, without one, from the catalog by its name."""

    name: str
    kind: Kind
    format: str = "parquet"
    path: str | None = None


@dataclass(frozen=True)
class Flow:
    """Fills `target` with what `body` returns for a session, or with the result of `sql`. A once flow runs on its first run and on full refreshes."""

    name: str
    target: str
    body: Body | None = None
    sql: str | None = None
    once: bool = False


@dataclass(frozen=True)
class AutoCdc:
    """Applies change rows of `source` to the streaming table `target`: one current row for each key (SCD type 1).

    `sequence_by` orders the changes of a key; `apply_as_deletes` and `apply_as_truncates` are SQL conditions on
    change rows; `columns` and `except_columns` choose the columns of the target; where `ignore_null_updates` (True,
    or the names of columns), a null keeps the value before.
    """

    name: str
    target: str
    source: str
    keys: tuple[str, ...]
    sequence_by: str
    apply_as_deletes: str | None = None
    apply_as_truncates: str | None = None
    columns: tuple[str, ...] | None = None
    except_columns: tuple[str, ...] = ()
    ignore_null_updates: bool | tuple[str, ...] = False
    once: bool = False


@dataclass(frozen=True)
class Problem:
    """One finding: its kind, the dataset or flow it is about, and what it says."""

    kind: str
    about: str
    message: str

    def __str__(self) -> str:
        return self.message


class InvalidPipeline(Exception):
    """A pipeline with problems; never empty."""

    def __init__(self, problems: Sequence[Problem]):
        self.problems = tuple(problems)
        super().__init__("pipeline graph is invalid:\n" + "\n".join(f"  - {p}" for p in problems))


@dataclass
class Pipeline:
    """An unordered collection of datasets and flows; `+` puts two together, in either order with the same meaning."""

    datasets: list[Dataset] = field(default_factory=list)
    flows: list[Flow | AutoCdc] = field(default_factory=list)

    def __add__(self, other: Pipeline) -> Pipeline:
        return Pipeline(self.datasets + other.datasets, self.flows + other.flows)

    def _add(self, name: str, kind: Kind, format: str = "parquet", path: str | None = None) -> None:
        self.datasets.append(Dataset(name, kind, format, path))

    def _declare(self, name: str | None, kind: Kind, once: bool = False, format: str = "parquet") -> Callable[[Body], Body]:
        def wrap(body: Body) -> Body:
            own = name or body.__name__
            self._add(own, kind, format)
            self.flows.append(Flow(own, own, body, once=once))
            return body

        return wrap

    def external(self, name: str, path: str | None = None, format: str = "parquet") -> None:
        """Something that exists already: only read."""
        self._add(name, Kind.EXTERNAL, format, path)

    def table(self, name: str | None = None, *, format: str = "parquet", once: bool = False) -> Callable[[Body], Body]:
        """Decorator: a batch table filled by the function; with once=True filled a single time."""
        return self._declare(name, Kind.TABLE, once, format)

    def declare_table(self, name: str, *, format: str = "parquet") -> None:
        """A table without a flow of its own; append_flow fills it."""
        self._add(name, Kind.TABLE, format)

    def materialized_view(self, name: str | None = None, *, format: str = "parquet") -> Callable[[Body], Body]:
        return self._declare(name, Kind.MATERIALIZED_VIEW, format=format)

    def temporary_view(self, name: str | None = None) -> Callable[[Body], Body]:
        return self._declare(name, Kind.TEMPORARY_VIEW)

    def streaming_table(self, name: str | None = None, *, format: str = "parquet", once: bool = False) -> Callable[[Body], Body]:
        """Decorator: the function returns a streaming DataFrame, or with once=True a batch one that is appended a single time."""
        return self._declare(name, Kind.STREAMING_TABLE, once, format)

    def _sql(self, name: str, kind: Kind, sql: str) -> None:
        self._add(name, kind)
        self.flows.append(Flow(name, name, sql=sql))

    def materialized_view_sql(self, name: str, sql: str) -> None:
        self._sql(name, Kind.MATERIALIZED_VIEW, sql)

    def temporary_view_sql(self, name: str, sql: str) -> None:
        self._sql(name, Kind.TEMPORARY_VIEW, sql)

    def streaming_table_sql(self, name: str, sql: str) -> None:
        """SQL that reads a stream: SELECT ... FROM STREAM(name)."""
        self._sql(name, Kind.STREAMING_TABLE, sql)

    def create_streaming_table(self, name: str) -> None:
        """A streaming table without a flow of its own; append_flow or create_auto_cdc_flow fill it."""
        self._add(name, Kind.STREAMING_TABLE)

    def append_flow(self, target: str, name: str | None = None, *, once: bool = False) -> Callable[[Body], Body]:
        def wrap(body: Body) -> Body:
            self.flows.append(Flow(name or body.__name__, target, body, once=once))
            return body

        return wrap

    def create_auto_cdc_flow(self, target: str, source: str, keys: Sequence[str], sequence_by: str, *, apply_as_deletes: str | None = None, apply_as_truncates: str | None = None, column_list: Sequence[str] | None = None, except_column_list: Sequence[str] = (), ignore_null_updates: bool | Sequence[str] = False, stored_as_scd_type: int = 1, name: str | None = None, once: bool = False) -> None:
        if stored_as_scd_type != 1:
            raise ValueError("only SCD type 1 is supported")
        if column_list is not None and except_column_list:
            raise ValueError("give column_list or except_column_list, not both")
        ignore = ignore_null_updates if isinstance(ignore_null_updates, bool) else tuple(ignore_null_updates)
        self.flows.append(AutoCdc(name or f"{target}_auto_cdc", target, source, tuple(keys), sequence_by, apply_as_deletes, apply_as_truncates, None if column_list is None else tuple(column_list), tuple(except_column_list), ignore, once))
