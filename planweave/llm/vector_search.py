"""What the vector searches share: classes of equal vectors, blocks of queries, and the best rows of each query.

Queries and rows with equal vectors are searched once. A class keeps its k + 1 smallest ids, which is all that k
nearest rows with ties to the smaller id, less the query's own, can need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship, vectors

#: Different query vectors that are sent to the executors at once.
QUERIES_AT_ONCE = 2048


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows with an id and a vector that isn't empty."""
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x")).where("id is not null and size(x) > 0")


def widths(given: DataFrame) -> list[int]:
    """The lengths that occur. Vectors of different lengths have no distance: each length is searched apart."""
    return [r["n"] for r in given.select(F.size("x").alias("n")).distinct().orderBy("n").collect()]


def classes(given: DataFrame, keep: int, change: Callable[[np.ndarray], np.ndarray], zero: bool) -> DataFrame:
    """(v binary, ids array<long>): the different vectors of usable() as doubles after `change`, with their `keep` smallest ids.

    Vectors that hold null or non-finite components take no part; zero vectors do if `zero`. Each batch sends at most
    `keep` ids of a vector and each task keeps the smallest of them before the exchange, so a vector shared by any number
    of rows stays small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, fine = vectors(batch.column("x"))
            x, ids = change(x[fine]), batch.column("id").to_numpy()[fine]
            if not zero:
                ids, x = ids[x.any(axis=1)], x[x.any(axis=1)]
            own: dict[bytes, list[int]] = {}
            for k in np.argsort(ids, kind="stable").tolist():
                same = own.setdefault(x[k].tobytes(), [])
                if len(same) < keep and int(ids[k]) not in same:
                    same.append(int(ids[k]))
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([v for v, same in own.items() for _ in same], pa.binary()), pa.array([i for same in own.values() for i in same], pa.int64())], ["v", "id"])

    ship(given.sparkSession)
    first = Window.partitionBy("v").orderBy("id")
    found = given.mapInArrow(run, "v binary, id long").withColumn("k", F.dense_rank().over(first)).where(F.col("k") <= keep)
    return found.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def matrix(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1) if values else np.zeros((0, 0))


class Best:
    """The `keep` best rows of each query so far: smallest cost, then smallest id. Costs of `kind` are below `none`."""

    def __init__(self, queries: int, keep: int, kind: type = np.float64):
        self.keep, self.none = keep, np.inf if kind is np.float64 else np.iinfo(kind).max
        self.cost, self.id = np.full((queries, keep), self.none, kind), np.full((queries, keep), np.iinfo(np.int64).max)

    def worst(self, q: np.ndarray) -> np.ndarray:
        return self.cost[q, -1]

    def add(self, q: np.ndarray, cost: np.ndarray, ids: np.ndarray) -> None:
        """Further rows: cost and ids by query of q; missing ones cost `none`."""
        cost, ids = np.concatenate([self.cost[q], cost], axis=1), np.concatenate([self.id[q], ids], axis=1)
        order = np.lexsort((ids, cost), axis=1)[:, : self.keep]
        self.cost[q], self.id[q] = np.take_along_axis(cost, order, 1), np.take_along_axis(ids, order, 1)


def nearest_classes(cost: np.ndarray, first: np.ndarray, keep: int) -> np.ndarray:
    """By row of cost the columns of its `keep` smallest, ties to the smaller `first`."""
    if cost.shape[1] > keep:
        # all that are as near as the last one kept, so that ties are cut by id
        limit = np.partition(cost, keep - 1, axis=1)[:, keep - 1]
        width = int((cost <= limit[:, None]).sum(axis=1).max())
        if width > keep:
            masked = np.where(cost <= limit[:, None], cost, cost.max())  # none of these is among the first
            return np.lexsort((np.broadcast_to(first, cost.shape), masked), axis=1)[:, :keep]
        return np.argpartition(cost, keep - 1, axis=1)[:, :keep]
    return np.broadcast_to(np.arange(cost.shape[1]), cost.shape)


def expand(best: Best, q: np.ndarray, cost: np.ndarray, ids: np.ndarray) -> None:
    """Adds classes to best: cost by query and class, ids by class (padded with the largest long)."""
    near = nearest_classes(cost, ids[:, 0], best.keep)
    picked = ids[near]
    each = np.repeat(np.take_along_axis(cost, near, 1)[:, :, None], ids.shape[1], axis=2)
    each = np.where(picked == np.iinfo(np.int64).max, best.none, each)
    best.add(q, each.reshape(len(q), -1), picked.reshape(len(q), -1))


def padded(ids: pa.Array, keep: int) -> np.ndarray:
    out = np.full((len(ids), keep), np.iinfo(np.int64).max)
    for k, x in enumerate(ids.to_pylist()):
        out[k, : len(x)] = x
    return out


def search(index: DataFrame, asked: DataFrame, k: int, task: Callable[[np.ndarray], Callable[[Iterator[pa.RecordBatch]], Best]], score: Column, cost: str = "double") -> DataFrame:
    """(query_id, rank, vec_id, score): task gets a block of query vectors and returns what a task does with its rows of the index.

    asked: (v, query_id). The queries go out in blocks of a bounded size; each task returns its best k + 1 rows
    of each query, and the best of these are kept by query.
    """
    groups = cut(asked.groupBy("v").agg(F.min("query_id").alias("q")))
    blocks = -(-groups.count() // QUERIES_AT_ONCE)
    ship(index.sparkSession)
    found = None
    for b in range(max(1, blocks)):
        mine = groups.where(F.pmod(F.xxhash64("q"), F.lit(max(1, blocks))) == b).orderBy("q").collect()
        names, work = np.array([r["q"] for r in mine], np.int64), task(matrix([bytes(r["v"]) for r in mine]))

        def run(batches: Iterator[pa.RecordBatch], names=names, work=work) -> Iterator[pa.RecordBatch]:
            if len(names):
                best = work(batches)
                at, column = np.nonzero(best.cost < best.none)
                yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(best.id[at, column]), pa.array(best.cost[at, column])], ["q", "vec_id", "cost"])

        part = index.mapInArrow(run, f"q long, vec_id long, cost {cost}")
        order = Window.partitionBy("q").orderBy("cost", "vec_id")
        part = cut(part.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1))
        found = part if found is None else found.union(part)
    members = asked.join(groups, "v").select("q", "query_id")
    out = members.join(found, "q").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy("cost", "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


def asked_of(given: DataFrame, every: int, change: Callable[[np.ndarray], np.ndarray], zero: bool) -> DataFrame:
    """(v, query_id) of the rows of usable() whose id is divisible by `every`, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, fine = vectors(batch.column("x"))
                x, ids = change(x[fine]), batch.column("id").to_numpy()[fine]
                if not zero:
                    ids, x = ids[x.any(axis=1)], x[x.any(axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary()), pa.array(ids)], ["v", "query_id"])

    ship(given.sparkSession)
    return given.where(F.col("id") % every == 0).mapInArrow(run, "v binary, query_id long").distinct()
