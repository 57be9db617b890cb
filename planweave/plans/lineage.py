"""What a flow reads: sessions that record named reads, and the relations of a SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (name, streaming) -> DataFrame
Resolve = Callable[[str, bool], DataFrame]


def _seq(x: Any) -> Iterator[Any]:
    it = x.iterator()
    while it.hasNext():
        yield it.next()


def sql_reads(spark: SparkSession, sql: str) -> list[tuple[str, bool]]:
    """(name, streaming) of every relation that the text reads, subqueries and common table expressions included, in the order of their names."""
    return sorted({(name, streaming) for name, streaming, _ in _relations(spark, sql)[0]})


#: Name, streaming, and from where to where in the text.
Place = tuple[str, bool, tuple[int, int]]


def _relations(spark: SparkSession, sql: str) -> tuple[list[Place], list[tuple[list[str], tuple[int, int]]]]:
    """The relations that the text reads, and the parts of its column names."""
    found: list[Place] = []
    columns: list[tuple[list[str], tuple[int, int]]] = []
    _walk(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), frozenset(), found, columns)
    return found, columns


def _span(node: Any) -> tuple[int, int]:
    o = node.origin()
    return (o.startIndex().get(), o.stopIndex().get() + 1) if o.startIndex().isDefined() and o.stopIndex().isDefined() else (-1, -1)


def _walk(node: Any, defined: frozenset[str], found: list[Place], columns: list[tuple[list[str], tuple[int, int]]]) -> None:
    kind = node.getClass().getSimpleName()
    if kind == "UnresolvedRelation":
        name = ".".join(_seq(node.multipartIdentifier()))
        if name.lower() not in defined:
            found.append((name, bool(node.isStreaming()), _span(node)))
    if kind == "UnresolvedWith":
        for entry in _seq(node.cteRelations()):
            _walk(entry._2(), defined, found, columns)
            defined = defined | {entry._1().lower()}
    for e in _seq(node.expressions()):
        _names(e, columns)
    for child in _seq(node.children()):
        _walk(child, defined, found, columns)
    for plan in _seq(node.subqueries()):
        _walk(plan, defined, found, columns)


def _names(e: Any, columns: list[tuple[list[str], tuple[int, int]]]) -> None:
    if e.getClass().getSimpleName() == "UnresolvedAttribute":
        columns.append((list(_seq(e.nameParts())), _span(e)))
    for child in _seq(e.children()):
        _names(child, columns)


def without_dots(spark: SparkSession, sql: str) -> tuple[str, dict[tuple[str, bool], str]]:
    """(text, view by relation): the text with every relation of a dotted name under a name that a view can have.

    That is its last part where nothing else in the text is called so; columns qualified by the whole name follow.
    """
    places, columns = _relations(spark, sql)
    names = sorted({(n, s) for n, s, _ in places})
    views = {(n, s): n for n, s in names if "." not in n}
    # a name that is read both ways has two views; texts without dots stay as they are
    taken = {v.lower() for v in views.values()}
    last = [n.rsplit(".", 1)[1].lower() for n, _ in names if "." in n]
    for n, s in names:
        if "." in n:
            short = n.rsplit(".", 1)[1]
            if short.lower() in taken or last.count(short.lower()) > 1:
                short = n.replace(".", "__") + "__stream" * s
            taken.add(short.lower())
            views[n, s] = short
    edits: list[tuple[tuple[int, int], str]] = []
    for n, s, (a, b) in places:
        if "." in n:
            parts = r"\s*\.\s*".join(f"(?:`{re.escape(p)}`|{re.escape(p)})" for p in n.split("."))
            edits.append(((a, b), re.sub(parts, lambda _, v=views[n, s]: f"`{v}`", sql[a:b], count=1, flags=re.I)))
    whole = {tuple(p.lower() for p in n.split(".")): views[n, s] for n, s in names if "." in n}
    for parts_, (a, b) in columns:
        for k in range(len(parts_) - 1, 1, -1):
            if a >= 0 and (v := whole.get(tuple(p.lower() for p in parts_[:k]))):
                edits.append(((a, b), ".".join(f"`{p}`" for p in [v, *parts_[k:]])))
                break
    for (a, b), text in sorted(edits, reverse=True):
        sql = sql[:a] + text + sql[b:]
    return sql, views


class Reader:
    """Stands for spark.read or spark.readStream in a flow: table() goes through the recorder, all else to Spark."""

    def __init__(self, recorder: Recorder, streaming: bool):
        self._recorder, self._streaming = recorder, streaming

    def table(self, name: str) -> DataFrame:
        return self._recorder._read(name, self._streaming)

    def __getattr__(self, name: str) -> Any:
        spark = self._recorder._spark
        return getattr(spark.readStream if self._streaming else spark.read, name)


class Recorder:
    """Stands for the session in a flow. Named reads are noted and resolved by the pipeline; SQL sees the datasets it names as views."""

    def __init__(self, spark: SparkSession, resolve: Resolve):
        self._spark, self._resolve, self.reads = spark, resolve, []  # type: ignore[var-annotated]

    def _read(self, name: str, streaming: bool) -> DataFrame:
        if (name, streaming) not in self.reads:
            self.reads.append((name, streaming))
        return self._resolve(name, streaming)

    def table(self, name: str) -> DataFrame:
        return self._read(name, False)

    @property
    def read(self) -> Reader:
        return Reader(self, False)

    @property
    def readStream(self) -> Reader:  # noqa: N802
        return Reader(self, True)

    def sql(self, text: str) -> DataFrame:
        session = self._spark.newSession()
        plain, views = without_dots(self._spark, text)
        for (name, streaming), view in views.items():
            df = self._read(name, streaming)
            df._jdf.createOrReplaceTempView(f"`{view}`") if df.sparkSession is session else _view(session, df, f"`{view}`")
        return session.sql(plain)

    def __getattr__(self, name: str) -> Any:
        return getattr(self._spark, name)


def _view(session: SparkSession, df: DataFrame, name: str) -> None:
    """The plan of df as a view of another session of the same context."""
    plan = session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, df._jdf.logicalPlan())
    plan.createOrReplaceTempView(name)


class Unresolved:
    """What a read gives that can't be resolved: every use of it gives itself, so that later reads are still recorded."""

    def __getattr__(self, name: str) -> Any:
        if name.startswith("__"):
            raise AttributeError(name)
        return (lambda *a, **k: F.lit(None)) if name in ("exists", "scalar") else self

    def __call__(self, *args: Any, **kwargs: Any) -> Unresolved:
        return self

    def __getitem__(self, key: Any) -> Unresolved:
        return self
