"""Small helpers around a SparkSession that several modules use."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths that scratch() and cut() made, by application.
_made: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or on one machine, where it is unset, a temporary one."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="planweave-"))
    return jsc.getCheckpointDir().get()


def _note(spark: SparkSession, path: str) -> None:
    app = spark.sparkContext.applicationId
    if app not in _made:
        atexit.register(_at_exit, spark)
    _made.setdefault(app, []).append(path)


def clean(spark: SparkSession) -> None:
    """Deletes what scratch() and cut() made in this session; results that still read it are lost."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        clean(spark)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver ends, or by clean()."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _note(spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    _note(df.sparkSession, out._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
    return out
