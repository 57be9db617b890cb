"""Exact largest inner products by a pivot-distance index.

One more component makes all rows equally long, so that the largest inner product is the smallest distance. Rows are
keyed by their nearest pivot and the distance to it and dealt to tasks in this order. A task visits the annuli around
each pivot from the one nearest to the query's own distance on, and stops where the triangle inequality shows that no
row can be better than those found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship
from .vector_search import Best, asked_of, classes, expand, matrix, padded, search, usable, widths

#: Pivots (the different vectors of the smallest hashes), and rows of an annulus.
PIVOTS, ANNULUS = 64, 256
#: Relative slack of the bounds, far above rounding errors.
SLACK = 1e-9


def quantised(x: np.ndarray) -> np.ndarray:
    return np.floor(256 * x) + 0.0  # no negative zeros


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products, exactly; an error where one needs more than 64 bits."""
    most = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if a.shape[1] * most * most < 2**53:
        return (a @ b.T).astype(np.int64)
    if a.shape[1] * most * most < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    exact = whole(a) @ whole(b).T
    if any(abs(v) >= 2**63 - 1 for v in exact.ravel()):
        raise OverflowError("an inner product needs more than 64 bits")
    return exact.astype(np.int64)


def _distances(inner: np.ndarray, a2: np.ndarray, b2: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(a2[:, None] + b2 - 2 * inner, 0))


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(longest - (x**2).sum(axis=1), 0))])


def largest(rows: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the largest inner product of floor(256 x), exactly.

    Queries are the rows whose id is divisible by `every`, each against all rows but its own; equal scores go to
    the smaller id. Null, empty and non-finite vectors and rows without an id take no part; zero vectors do. Vectors of
    different lengths never meet. Rows with the same id and vector count once. A score of more than 64 bits is an error.
    """
    given = usable(rows, id_col, vector_col)
    parts = [_largest(given.where(F.size("x") == n), k, every) for n in widths(given)]
    return reduce(DataFrame.union, parts) if parts else rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _largest(rows: DataFrame, k: int, every: int) -> DataFrame:
    """largest() of vectors of one length."""
    found = cut(classes(rows, k + 1, quantised, zero=True))
    sample = found.orderBy(F.xxhash64("v"), "v").limit(PIVOTS).collect()
    pivots = matrix([bytes(r["v"]) for r in sample])
    ship(rows.sparkSession)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array((matrix([bytes(v) for v in batch.column("v").to_pylist()]) ** 2).sum(axis=1).max(keepdims=True))], ["n"])

    longest = found.select("v").mapInArrow(lengths, "n double").agg(F.max("n")).first()[0] or 0.0
    lifted = _lifted(pivots, longest) if len(pivots) else np.zeros((0, 1))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _lifted(matrix([bytes(v) for v in batch.column("v").to_pylist()]), longest)
                far = _distances(x @ lifted.T, (x**2).sum(axis=1), (lifted**2).sum(axis=1))
                pivot = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pivot.astype(np.int32)), pa.array(far[np.arange(len(x)), pivot]), *(batch.column(c) for c in ("v", "ids"))], ["pivot", "far", "v", "ids"])

    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    index = cut(found.mapInArrow(keyed, "pivot int, far double, v binary, ids array<long>").repartitionByRange(parts, "pivot", "far").sortWithinPartitions("pivot", "far", "v"))

    def task(queries: np.ndarray):
        known = products(queries, pivots)
        # the pivots are rows too: nothing below the (k + 1)-th best of them is among a query's k + 1 best
        first = -np.sort(-known, axis=1)[:, k] if known.shape[1] > k else np.full(len(queries), -np.inf)

        def work(batches: Iterator[pa.RecordBatch]) -> Best:
            best, squares = Best(len(queries), k + 1, np.int64), (queries**2).sum(axis=1)
            to_pivots = _distances(known, squares, (lifted**2).sum(axis=1))
            for batch in batches:
                if not batch.num_rows:
                    continue
                pivot, far = batch.column("pivot").to_numpy(), batch.column("far").to_numpy()
                x, ids = matrix([bytes(v) for v in batch.column("v").to_pylist()]), padded(batch.column("ids"), k + 1)
                edges = np.flatnonzero(np.diff(pivot)) + 1
                for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(pivot)]):
                    _visit(best, queries, squares, longest, to_pivots[:, pivot[a]], first, far[a:b], x[a:b], ids[a:b])
            return best

        return work

    return search(index, asked_of(rows, every, quantised, True), k, task, -F.col("cost"), "long")


def _visit(best: Best, queries: np.ndarray, squares: np.ndarray, longest: float, own: np.ndarray, first: np.ndarray, far: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
    """One pivot's rows, sorted by distance: by query the annuli in the order of their lower bounds."""
    starts = np.arange(0, len(far), ANNULUS)
    low, high = far[starts], far[np.minimum(starts + ANNULUS, len(far)) - 1]
    bound = np.maximum(0, np.maximum(low - own[:, None], own[:, None] - high))
    order = np.argsort(bound, axis=1, kind="stable")
    active = np.arange(len(queries))
    for step in range(len(starts)):
        annulus = order[active, step]
        # the worst score kept so far, as a distance: sqrt(|q|^2 + longest - 2 score)
        worst = np.minimum(np.where(best.worst(active) == best.none, np.inf, best.worst(active).astype(float)), -first[active])
        reach = np.sqrt(np.maximum(squares[active] + longest + 2 * worst, 0))
        near = bound[active, annulus] <= reach * (1 + SLACK) + SLACK * np.sqrt(squares[active] + longest)
        active, annulus = active[near], annulus[near]  # later annuli of the others are farther still
        if not len(active):
            return
        for k in np.unique(annulus).tolist():
            q, a = active[annulus == k], starts[k]
            expand(best, q, -products(queries[q], x[a : a + ANNULUS]), ids[a : a + ANNULUS])
