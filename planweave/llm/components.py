"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, ship


def label(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a[i]-b[i]: each node's smallest reachable node."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


#: Links that one task contracts at once.
AT_ONCE = 2**20


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links as stars, AT_ONCE of them together, which hold the same connections in at most as many rows."""
    held: list[pa.RecordBatch] = []

    def stars() -> Iterator[pa.RecordBatch]:
        a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) if held else np.zeros(0, np.int64) for k in ("a", "b"))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = label(len(nodes), at[: len(a)], at[len(a) :])
        own = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], ["a", "b"])
        held.clear()

    for batch in batches:
        if held and sum(x.num_rows for x in held) + batch.num_rows > AT_ONCE:
            yield from stars()
        held.append(batch)
    yield from stars()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of a link, with the smallest node that it is connected to.

    Nodes are longs. Links with a null end are ignored, self-links and repeated links do no harm, an empty
    table gives an empty table. First every task contracts its links to stars; AT_ONCE links or fewer are one task's,
    which is the end of it. Else each round is two partially aggregated minima and two equi-joins, cut off by a
    checkpoint; rounds grow with the logarithm of the longest path.
    """
    links = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    ship(links.sparkSession)
    links = cut(links.mapInArrow(_forest, "a long, b long").distinct())
    size = None
    if links.count() <= AT_ONCE:
        before, links = links, cut(links.coalesce(1).mapInArrow(_forest, "a long, b long"))
        drop(before)
        return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())
    while True:
        before = links
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        links = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        links = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
        links = cut(links.select("x.a", "x.b").where("a <> b").distinct())
        drop(before)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == size:
            break
        size = now
    return links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(links.select("b", "b").distinct())
