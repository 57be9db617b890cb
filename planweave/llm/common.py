"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Only on one machine (tests, a laptop) a temporary folder takes its place where that setting is absent.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="planweave-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Folders that operators wrote, by application.
_written: dict[str, list[str]] = {}


#: Spark's setting by which a query's shuffle files go as soon as it has run.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes df once to the shared folder. drop() deletes what is no longer needed, clean() the rest.

    What was shuffled for it goes at once: else the executors keep it until the driver's garbage collector finds the plan.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        out = df.select("*").checkpoint(eager=True)  # a query of its own, which takes the setting
    finally:
        spark.conf.unset(_SHUFFLES_GO) if before is None else spark.conf.set(_SHUFFLES_GO, before)
    until_exit(spark, _folder_of(out))
    return out


def until_exit(spark: SparkSession, path: str) -> None:
    """The path goes when the driver ends, or by clean()."""
    app = spark.sparkContext.applicationId
    if app not in _written:
        atexit.register(_clean_at_exit, spark)
    _written.setdefault(app, []).append(path)


def _clean_at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        clean(spark)


def _folder_of(df: DataFrame) -> str:
    return df._jdf.queryExecution().logical().rdd().getCheckpointFile().get()


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables of cut() that nothing reads any more."""
    for df in tables:
        path, spark = _folder_of(df), df.sparkSession
        delete(spark, path)
        own = _written.get(spark.sparkContext.applicationId, [])
        if path in own:
            own.remove(path)


def clean(spark: SparkSession) -> None:
    """Deletes all that the operators of this session wrote in between; results that were not stored yet are lost."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers, once a context, so that they need no install and no shared folder."""
    sc = spark.sparkContext
    if getattr(sc, "_planweave_shipped", False):
        return
    top = Path(__file__).resolve().parents[2]
    folder = tempfile.mkdtemp(prefix="planweave-")  # the driver serves the file from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = Path(folder, "planweave.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(Path(__file__).resolve().parents[1].rglob("*.py")):
            z.write(p, p.relative_to(top))
    sc.addPyFile(str(name))
    sc._planweave_shipped = True


#: What a worker process keeps between tasks, by the module that it belongs to.
_held: dict[str, dict[Any, Any]] = {}


def held(owner: str, key: Any, build: Callable[[], Any]) -> Any:
    """build() once a worker process, for as long as it runs tasks of the same module: others free the memory."""
    for other in [o for o in _held if o != owner]:
        del _held[other]
    own = _held.setdefault(owner, {})
    if key not in own:
        own[key] = build()
    return own[key]


#: Rows that a step gets at once, so that what it makes of them stays small, and rows of an Arrow batch of texts: each
#: task holds a batch in Spark's own memory and another one in Python.
ROWS, BATCH = 1000, 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _free() -> None:
    """Gives the memory that a task has left to the system: the executor's next task may run in another process."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def per_batch(df: DataFrame, schema: T.StructType | str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], rows: int | None = ROWS) -> DataFrame:
    """Runs make() once a task and the function it returns once for at most `rows` rows, or a whole Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(make.__module__, None, lambda: None)
        step = make()
        for batch in batches:
            size = rows or batch.num_rows
            for k in range(0, batch.num_rows, max(1, size)):
                if (out := step(batch.slice(k, size))) is not None:
                    yield out
        del step
        _free()

    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(_BATCH) == "10000":  # Spark's default; a session that names another number keeps it
        spark.conf.set(_BATCH, str(BATCH))
    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str | int) -> list[str]:
    """The column as str, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


class Ragged:
    """Rows of different lengths, by number."""

    def __init__(self, kind: str):
        self.values, self.ends = np.zeros(0, kind), np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.ends) - 1

    def add(self, rows: list[bytes]) -> None:
        lengths = np.fromiter(map(len, rows), np.int64, len(rows)) // self.values.itemsize
        self.extend(np.frombuffer(b"".join(rows), self.values.dtype), np.cumsum(lengths))

    def extend(self, values: np.ndarray, ends: np.ndarray) -> None:
        """Further rows, one after another, and where each ends."""
        self.values, self.ends = np.concatenate([self.values, values]), np.concatenate([self.ends, self.ends[-1] + ends])

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows one after another, and where each ends."""
        length = (self.ends[1:] - self.ends[:-1])[numbers]
        to = np.cumsum(length)
        # value k of a row is as far from its row's first value there as here
        return self.values[np.repeat(self.ends[numbers] - to + length, length) + np.arange(to[-1] if len(to) else 0)], to


class Remembered:
    """What was made of texts, as rows of bytes, in two generations: what is not asked for while a generation fills is forgotten.

    A generation holds `most` texts, and more only if they are asked for at once.
    """

    def __init__(self, kinds: tuple[str, ...], most: int, make: Callable[[list[str]], list[list[bytes]]]):
        self.kinds, self.most, self.make = kinds, most, make
        self.known, self.rows = {}, [Ragged(k) for k in kinds]
        self.old, self.old_rows = {}, self.rows

    def _add(self, keys: list[str], rows: list[list[bytes]]) -> None:
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(keys))))
        for own, new in zip(self.rows, rows):
            own.add(new)

    def numbers(self, keys: list[str]) -> np.ndarray:
        """The numbers of different texts, by which self.rows has what was made of them."""
        new = [k for k in keys if k not in self.known]
        if self.known and len(self.known) + len(new) > self.most:
            self.old, self.old_rows = self.known, self.rows
            self.known, self.rows, new = {}, [Ragged(k) for k in self.kinds], keys
        again = [k for k in new if k in self.old]
        if again:
            at = np.fromiter(map(self.old.__getitem__, again), np.int64, len(again))
            self.known.update(zip(again, range(len(self.known), len(self.known) + len(again))))
            for own, before in zip(self.rows, self.old_rows):
                own.extend(*before.gather(at))
            new = [k for k in new if k not in self.known]
        for k in range(0, len(new), 100_000):
            self._add(new[k : k + 100_000], self.make(new[k : k + 100_000]))
        return np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))


def slices(given: pa.Array, size: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows as large strings, null as the empty text) of about `size` bytes of text, or of one longer text."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(given), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(given):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)))
        yield at, given[at:to].cast(pa.large_string()).fill_null("")
        at = to


def hex64(c: Column | str) -> Column:
    """The 64 bits of a long as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column as (matrix of doubles, mask of usable rows).

    Unusable: null, holding a null or a non-finite component, or of another length than the longest one.
    """
    rows = column.to_pylist()
    width = max((len(x) for x in rows if x is not None), default=0)
    out = np.full((len(rows), width), np.nan)
    for i, x in enumerate(rows):
        if x is not None and len(x) == width and width:
            out[i] = [np.nan if v is None else v for v in x]
    return out, np.isfinite(out).all(axis=1) & (width > 0)


def place(columns: list[str], name: str) -> int:
    """Where the column is: the one spelled like that, else the only one that differs in case alone."""
    if columns.count(name) == 1:
        return columns.index(name)
    like = [k for k, c in enumerate(columns) if c.lower() == name.lower()]
    if len(like) != 1:
        raise ValueError(f"{len(like)} columns are named {name!r}: {columns}")
    return like[0]


def column(df: DataFrame, name: str, alias: str = "text") -> DataFrame:
    """The column alone, whatever names the others have."""
    at = place(df.columns, name)
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).select(F.col(f"c{at}").alias(alias))


def filtered(df: DataFrame, text_col: str, make: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """The rows, with all their columns, whose texts the function that make() returns keeps; null texts are empty."""
    at = place(df.columns, text_col)

    def rows() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        keep = make()
        return lambda batch: batch.filter(pa.array(keep(texts(batch, at)), pa.bool_()))

    rows.__module__ = make.__module__
    return per_batch(df, df.schema, rows)
