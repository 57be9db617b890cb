"""Runs a pipeline: datasets in dependency order, batch by staged swaps, streams by availableNow with checkpoints."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..streaming import cdc
from .analysis import Plan, analyse, external
from .events import Event, State
from .lineage import Recorder
from .manifest import manifest
from .model import AutoCdc, Flow, Kind, Pipeline
from .storage import Storage


class RunFailed(Exception):
    """A flow failed; the events so far are attached."""

    def __init__(self, flow: str, cause: Exception, events: list[Event]):
        super().__init__(f"flow {flow} failed: {cause}")
        self.flow, self.cause, self.events = flow, cause, events


class Detached(Exception):
    """The time to wait is over; the stream goes on."""


class Runner:
    """Validates and runs a pipeline against a storage root."""

    def __init__(self, spark: SparkSession, pipeline: Pipeline, root: str, on_event: Callable[[Event], None] | None = None, timeout: float | None = 600, register: bool = False):
        self.spark, self.pipeline, self.storage = spark, pipeline, Storage(spark, root)
        self.on_event, self.timeout, self.register = on_event, timeout, register
        self.events: list[Event] = []
        self._views: dict[str, DataFrame] = {}

    def validate(self) -> Plan:
        return analyse(self.spark, self.pipeline)

    def manifest(self) -> str:
        return manifest(self.validate())

    def dry_run(self) -> Plan:
        """Validation, and whether every stream could be started in append mode. No job runs."""
        plan = analyse(self.spark, self.pipeline, streams=True)
        self._plan = plan
        for name in plan.order:
            for f in plan.flows_of(name):
                self._say(f.name, State.PLANNING)
        return plan

    def _say(self, flow: str, state: State, message: str = "") -> None:
        event = Event(flow, state, message)
        self.events.append(event)
        if self.on_event:
            self.on_event(event)

    def resolve(self, name: str, streaming: bool) -> DataFrame:
        d = self._plan.dataset(name)
        if d.kind is Kind.EXTERNAL:
            return external(self.spark, d, streaming)
        if d.kind is Kind.TEMPORARY_VIEW:
            if name not in self._views:
                self._views[name] = self._body(self._plan.flows_of(name)[0])
            return self._views[name]
        return self.storage.read(d, [f.name for f in self._plan.flows_of(name)], self._plan.schemas[name], streaming)

    def _body(self, f: Any) -> DataFrame:
        recorder = Recorder(self.spark, self.resolve)
        return recorder.sql(f.sql) if f.sql is not None else f.body(recorder)

    def run(self, only: Iterable[str] | None = None, full_refresh: Iterable[str] | bool = ()) -> list[Event]:
        """Runs the flows of all datasets, or of `only`. full_refresh forgets datasets first (True: all that run)."""
        self._plan, self._views, self.events = self.validate(), {}, []
        chosen = set(self._plan.order if only is None else only)
        if unknown := chosen - set(self._plan.order):
            raise ValueError(f"no such datasets: {', '.join(sorted(unknown))}")
        fresh = chosen if full_refresh is True else set(full_refresh or ())
        todo = [(n, f) for n in self._plan.order for f in self._plan.flows_of(n)]
        for n, f in todo:
            self._say(f.name, State.QUEUED if n in chosen else State.EXCLUDED)
        for name in self._plan.order:
            if name in chosen:
                self._dataset(name, name in fresh)
        return self.events

    def _dataset(self, name: str, fresh: bool) -> None:
        d, flows = self._plan.dataset(name), self._plan.flows_of(name)
        if d.kind in (Kind.EXTERNAL, Kind.TEMPORARY_VIEW) or not flows:
            for f in flows:
                self._say(f.name, State.COMPLETED, "view")
            return
        if fresh:
            self.storage.forget(name, [f.name for f in flows])
        self.storage.keep_schema(name, self._plan.schemas[name])
        if d.kind is Kind.STREAMING_TABLE:
            for f in flows:
                self._guarded(f, self._cdc if isinstance(f, AutoCdc) else self._once if f.once else self._stream)
        else:
            self._batch(name, [f for f in flows if isinstance(f, Flow)])
        if self.register:
            self.storage.register(d, [f.name for f in flows], self._plan.schemas[name])

    def _guarded(self, f: Any, work: Callable[[Any], str]) -> None:
        self._say(f.name, State.STARTING)
        try:
            self._say(f.name, State.COMPLETED, work(f))
        except Detached:
            self._say(f.name, State.RUNNING, "detached: it goes on")
        except Exception as e:
            self._say(f.name, State.FAILED, str(e).splitlines()[0] if str(e) else type(e).__name__)
            raise RunFailed(f.name, e, list(self.events)) from e

    def _batch(self, name: str, flows: list[Flow]) -> None:
        """A batch table is the union of its flows. If all are once flows that have run, it stays as it is."""
        if all(f.once and self.storage.marker("once", f.name) for f in flows):
            for f in flows:
                self._say(f.name, State.IDLE, "has run")
                self._say(f.name, State.COMPLETED)
            return

        def work(_: Any) -> str:
            whole = None
            for f in flows:
                df = self._body(f)
                whole = df if whole is None else whole.unionByName(df)
            self.storage.swap(whole, self.storage.data(name), self._plan.dataset(name).format)
            for f in flows:
                if f.once:
                    self.storage.write_text(self.storage.at("once", f.name), "done")
            return ""

        for f in flows[:1]:
            self._guarded(f, work)
        for f in flows[1:]:
            self._say(f.name, State.COMPLETED)

    def _once(self, f: Flow) -> str:
        """The batch is swapped in as the flow's folder, then marked: a run that was killed repeats without doubling rows."""
        if self.storage.marker("once", f.name):
            return "has run"
        self.storage.swap(self._body(f), self._folder(f), self._plan.dataset(f.target).format)
        self.storage.write_text(self.storage.at("once", f.name), "done")
        return ""

    def _folder(self, f: Flow | AutoCdc) -> str:
        return f"{self.storage.data(f.target)}/{f.name}"

    def _wait(self, query: StreamingQuery) -> None:
        began = time.monotonic()
        while not query.awaitTermination(1):
            if self.timeout is not None and time.monotonic() - began > self.timeout:
                raise Detached

    def _stream(self, f: Flow) -> str:
        d = self._plan.dataset(f.target)
        writer = self._body(f).writeStream.format(d.format).option("path", self._folder(f)).option("checkpointLocation", self.storage.at("checkpoints", f.name))
        self._wait(writer.outputMode("append").trigger(availableNow=True).start())
        return ""

    def _cdc(self, f: AutoCdc) -> str:
        """A once flow applies what is there on its first run; a run that was killed or detached goes on before it is marked."""
        if f.once and self.storage.marker("once", f.name):
            return "has run"
        schema, storage = self._plan.schemas[f.target], self.storage
        columns, path = schema.names, storage.at("state", f.name, "rows")
        seen = storage.at("state", f.name, "batch")
        source = self.resolve(f.source, True)
        marks = storage.at("state", f.name, "truncate")

        changed = False
        # as many buckets as the session has shuffle partitions when the state is begun
        kept = storage.at("state", f.name, "buckets")
        if (buckets := storage.read_text(kept)) is None:
            buckets = self.spark.conf.get("spark.sql.shuffle.partitions")
            storage.write_text(kept, buckets)
        own = cdc.bucket(f, int(buckets))

        def apply(batch: DataFrame, number: int) -> None:
            nonlocal changed
            if int(storage.read_text(seen) or -1) >= number:
                return  # replayed
            changed = True
            batch = batch.persist()
            rows, truncates = cdc.changes(batch, f)
            new = cdc.reduce(rows, f, columns).withColumn(cdc.BUCKET, own).persist()
            touched = [r[0] for r in new.select(cdc.BUCKET).distinct().collect()]  # as many numbers as there are buckets, at most
            if touched:
                if storage.exists(path):
                    state = self.spark.read.schema(new.schema).parquet(path).where(F.col(cdc.BUCKET).isin(touched))
                    merged = cdc.merged(state, new, f, columns).withColumn(cdc.BUCKET, own)
                else:
                    merged = new
                # only the buckets that the batch touches; a batch that is repeated gives the same rows again
                merged.repartition(cdc.BUCKET).write.partitionBy(cdc.BUCKET).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
                self.spark.catalog.refreshByPath(path)
            if f.apply_as_truncates:
                if storage.exists(marks):
                    truncates = truncates.unionByName(self.spark.read.parquet(marks))
                # one row: the last truncate, which also reaches later, older changes
                storage.swap(truncates.agg(F.max("__seq").alias("__seq")), marks)
            storage.write_text(seen, str(number))
            new.unpersist()
            batch.unpersist()

        writer = source.writeStream.foreachBatch(apply).option("checkpointLocation", storage.at("checkpoints", f.name)).trigger(availableNow=True)
        self._wait(writer.start())
        if storage.exists(path) and (changed or not storage.exists(self._folder(f))):
            state = self.spark.read.parquet(path).drop(cdc.BUCKET)
            if storage.exists(marks):
                state = cdc.truncated(state.crossJoin(F.broadcast(self.spark.read.parquet(marks).withColumnRenamed("__seq", "__last"))), F.col("__last")).drop("__last")
            storage.swap(cdc.current(state, f, columns), self._folder(f))
        if f.once:
            storage.write_text(storage.at("once", f.name), "done")
        return ""


def watch(runner: Runner, every: float = 30, times: int | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
    """Runs again and again; the first failure ends it. Returns the number of runs."""
    n = 0
    while times is None or n < times:
        if n:
            sleep(every)
        runner.run()
        n += 1
    return n


def seed(spark: SparkSession, statements: Iterable[str]) -> int:
    """Runs SQL statements in order and stops at the first that fails, naming it."""
    n = 0
    for n, s in enumerate(statements, 1):
        try:
            spark.sql(s)
        except Exception as e:
            raise RuntimeError(f"statement {n} failed: {s.strip()[:200]}: {str(e).splitlines()[0]}") from e
    return n
