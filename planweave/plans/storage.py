"""Datasets on disk: a folder each under the storage root, rewritten by a staged write and a swap."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .model import Dataset, Kind


class Storage:
    """root/data/<name>: current files. root/schemas, checkpoints, once, state: what runs remember. Any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def data(self, name: str) -> str:
        return self.at("data", name)

    def exists(self, path: str) -> bool:
        return bool(self._fs.exists(self._path(path)))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def _move(self, a: str, b: str) -> None:
        target = self._path(b)
        self._fs.mkdirs(target.getParent())
        if not self._fs.rename(self._path(a), target):
            raise OSError(f"can't move {a} to {b}")

    def swap(self, df: DataFrame, path: str, format: str = "parquet") -> None:
        """Replaces the folder by df, which may read it. A run that is killed in between leaves the old files or the new ones."""
        new, old = self.at("staging", uuid.uuid4().hex), f"{path}.old"
        df.write.format(format).save(new)
        self.restore(path)
        if self.exists(path):
            self._move(path, old)
        self._move(new, path)
        self.delete(old)
        self.spark.catalog.refreshByPath(path)

    def restore(self, path: str) -> None:
        """Takes back what an interrupted swap has moved away."""
        old = f"{path}.old"
        if self.exists(old):
            if self.exists(path):
                self.delete(old)
            else:
                self._move(old, path)

    def write_text(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read_text(self, path: str) -> str | None:
        if not self.exists(path):
            return None
        stream = self._fs.open(self._path(path))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return str(text)

    def keep_schema(self, name: str, schema: T.StructType) -> None:
        self.write_text(self.at("schemas", name), schema.json())

    def schema(self, name: str) -> T.StructType | None:
        text = self.read_text(self.at("schemas", name))
        return T.StructType.fromJson(json.loads(text)) if text else None

    def read(self, d: Dataset, flows: list[str], schema: T.StructType, streaming: bool) -> DataFrame:
        """The dataset as a batch or a stream; one that was never filled is empty.

        A streaming table has a folder for each of its flows, because each stream keeps a log of its own files there.
        """
        parts = [self._part(d, path, schema, streaming) for path in self.folders(d, flows)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def folders(self, d: Dataset, flows: list[str]) -> list[str]:
        return [f"{self.data(d.name)}/{f}" for f in flows] if d.kind is Kind.STREAMING_TABLE and flows else [self.data(d.name)]

    def _part(self, d: Dataset, path: str, schema: T.StructType, streaming: bool) -> DataFrame:
        self.restore(path)
        if streaming:
            self._fs.mkdirs(self._path(path))
            return self.spark.readStream.format(d.format).schema(schema).load(path)
        if not self.exists(path) or not any(not f.getPath().getName().startswith(("_", ".")) for f in self._fs.listStatus(self._path(path))):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.format(d.format).schema(schema).load(path)

    def register(self, d: Dataset, flows: list[str], schema: T.StructType) -> None:
        """Makes the dataset known to the session's catalog by its name, again after a restart: a table, or a view over several flows."""
        folders = self.folders(d, flows)
        if len(folders) > 1:
            self.read(d, flows, schema, False).createOrReplaceTempView(d.name)
            return
        self.spark.sql("DROP TABLE IF EXISTS " + ".".join(f"`{part}`" for part in d.name.split(".")))
        self.spark.catalog.createTable(d.name, path=folders[0], source=d.format, schema=schema)

    def forget(self, name: str, flows: list[str]) -> None:
        """For a full refresh: data, checkpoints, once markers and state go."""
        for path in (self.data(name), f"{self.data(name)}.old", *(self.at(k, f) for f in flows for k in ("checkpoints", "once", "state"))):
            self.delete(path)

    def marker(self, *parts: str) -> Any:
        return self.read_text(self.at(*parts))
