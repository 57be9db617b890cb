"""SimHash near-duplicates, with candidates from pivot distance tables."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import near_copies
from .common import cut, drop, hex64, per_batch, texts
from .components import connected_components, label

SEED = 42
#: Reference fingerprints, to which every fingerprint's Hamming distance is tabulated.
PIVOTS = 32
#: Buckets of more fingerprints are dealt anew by finer keys; keys of such buckets that are broadcast at most.
WIDE, BROADCAST = 1024, 500_000
#: Fingerprints from which on those that differ in few bits are looked up by what is near, in place of all pairs.
MANY = 4096


def fingerprint(text: str, words: int = 3) -> int:
    """64 bits: a bit is 1 if it is set in over half of the XXH64 values of the word shingles."""
    parts = text.encode().lower().split()
    if not parts:
        return 0
    width, joined = min(words, len(parts)), b" ".join(parts)
    ends = np.cumsum([len(x) + 1 for x in parts]) - 1
    n = len(parts) - width + 1
    starts = np.concatenate([[0], ends[: n - 1] + 1])
    h, seed = xxhash.xxh64_intdigest, SEED
    values = np.array([h(joined[x:y], seed) for x, y in zip(starts.tolist(), ends[width - 1 :].tolist())], dtype="<u8")
    total = np.zeros(64, np.int64)
    for k in range(0, n, 4096):
        total += np.unpackbits(values[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp long): A-Z is lower-cased, words are parted by ASCII white space. A null text is empty; no words: 0."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = np.array([fingerprint(t, words) for t in texts(batch, "text")], dtype=np.uint64)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

        return step

    return per_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id long, fp long", make)


def _references() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2**64, PIVOTS, dtype=np.uint64)


def _tables(fp: np.ndarray, blocks: int) -> np.ndarray:
    """[fingerprint, block, reference]: Hamming distances within each of the equal blocks of bits; their sum over blocks is the distance."""
    width = 64 // blocks
    masks = np.array([((1 << width) - 1) << (width * k) for k in range(blocks)], dtype=np.uint64)
    return np.bitwise_count((fp[:, None, None] ^ _references()) & masks[:, None])


def _keyed(nodes: DataFrame, blocks: int, distance: int) -> DataFrame:
    """(part, key, node, fp) for each choice of blocks - distance blocks.

    Fingerprints at most `distance` bits apart agree on the table rows of at least one such choice, so they
    meet in a bucket: no link is lost.
    """

    def make():
        choices = list(combinations(range(blocks), blocks - distance))
        factors = np.random.default_rng(SEED + 1).integers(0, 2**63, (blocks, PIVOTS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            node, fp = batch.column("node").to_numpy(), batch.column("fp").to_numpy()
            rows = (_tables(fp.view(np.uint64), blocks).astype(np.uint64) * factors).sum(axis=2, dtype=np.uint64)
            keys = [rows[:, list(c)].sum(axis=1, dtype=np.uint64).view(np.int64) for c in choices]
            part = np.repeat(np.arange(len(choices), dtype=np.int32), len(node))
            return pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.concatenate(keys)), pa.array(np.tile(node, len(choices))), pa.array(np.tile(fp, len(choices)))], ["part", "key", "node", "fp"])

        return step

    return per_batch(nodes.select("node", "fp"), "part int, key long, node long, fp long", make)


def spanning(fp: np.ndarray, distance: int) -> np.ndarray:
    """For each fingerprint of a bucket the smallest index that it is linked to, over any number of steps.

    Pairs whose distances to some reference differ by more than `distance` are discarded (triangle
    inequality); the survivors' bits are compared.
    """
    free = np.bitwise_or.reduce(fp ^ fp[0])
    if len(fp) > MANY and int(free).bit_count() <= 16:
        return _spanning_near(fp, distance, free)
    far = np.bitwise_count(fp[:, None] ^ _references()).astype(np.int8)
    root, n, step = np.arange(len(fp)), len(fp), max(1, 2**21 // len(fp))
    for k in range(0, n, step):
        a, b = np.nonzero(np.abs(far[k : k + step, None, 0] - far[None, :, 0]) <= distance)
        a = a + k
        keep = b > a
        a, b = a[keep], b[keep]
        for r in range(1, PIVOTS):
            if not len(a):
                break
            keep = np.abs(far[a, r] - far[b, r]) <= distance
            a, b = a[keep], b[keep]
        keep = np.bitwise_count(fp[a] ^ fp[b]) <= distance
        a, b = np.concatenate([a[keep], np.arange(n)]), np.concatenate([b[keep], root])
        root = label(n, a, b)
    return root


def _spanning_near(fp: np.ndarray, distance: int, free: np.uint64) -> np.ndarray:
    """spanning() of different fingerprints that differ in the free bits alone: each one's neighbours are looked up among all."""
    order = np.argsort(fp)
    ranked, root, bits = fp[order], np.arange(len(fp)), [np.uint64(1 << k) for k in range(64) if int(free) >> k & 1]
    for n in range(1, distance + 1):
        for some in combinations(bits, n):
            other = fp ^ np.bitwise_or.reduce(some)
            at = np.minimum(np.searchsorted(ranked, other), len(fp) - 1)
            own = np.flatnonzero(ranked[at] == other)
            root = label(len(fp), np.concatenate([own, np.arange(len(fp))]), np.concatenate([order[at[own]], root]))
    return root


def _links(buckets: DataFrame, distance: int) -> DataFrame:
    """(a, b) of each bucket, as stars; a bucket of any density gives fewer links than it has fingerprints."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            items = batch.column("items")
            ends, flat = items.offsets.to_numpy(), items.flatten()
            node, fp = flat.field("node").to_numpy(zero_copy_only=False), flat.field("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            left, right, ends = [], [], ends - ends[0]
            pairs = ends[:-1][np.diff(ends) == 2]
            far = np.abs(np.bitwise_count(fp[pairs][:, None] ^ _references()).astype(np.int8) - np.bitwise_count(fp[pairs + 1][:, None] ^ _references()).astype(np.int8)).max(axis=1, initial=0)
            pairs = pairs[far <= distance]
            pairs = pairs[np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= distance]
            left.append(node[pairs])
            right.append(node[pairs + 1])
            for x, y in zip(ends[:-1].tolist(), ends[1:].tolist()):
                if y - x > 2:
                    root = spanning(fp[x:y], distance)
                    own = np.nonzero(root != np.arange(y - x))[0]
                    left.append(node[x + own])
                    right.append(node[x + root[own]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

        return step

    return per_batch(buckets.groupBy("part", "key").agg(F.collect_list(F.struct("node", "fp")).alias("items")).select("items"), "a long, b long", make)


def _several(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of buckets of 2 to WIDE nodes, rows of wider ones). Sizes are counted apart, so rows of a wide bucket never meet in one task."""
    rows = cut(keyed)
    sizes = rows.groupBy("part", "key").agg(F.count("*").alias("n"))
    wide = cut(sizes.where(F.col("n") > WIDE).select("part", "key"))
    far = F.broadcast(wide) if wide.count() <= BROADCAST else wide
    group = Window.partitionBy("part", "key")
    narrow = rows.join(far, ["part", "key"], "left_anti").withColumn("n", F.count("*").over(group)).where("n > 1")
    return narrow, rows.join(far, ["part", "key"], "left_semi")


def links_within(nodes: DataFrame, distance: int) -> DataFrame:
    """(a, b): stars that connect the nodes (node, fp) exactly as links of at most `distance` bits do; fingerprints differ."""
    blocks = 2 + distance if 64 % (2 + distance) == 0 else 8
    narrow, wide = _several(_keyed(nodes, blocks, distance))
    finer = _keyed(wide.select("node", "fp").distinct(), 8, distance).withColumn("n", F.count("*").over(Window.partitionBy("part", "key"))).where("n > 1")
    return _links(narrow, distance).union(_links(finer, distance))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest doc_id reachable over links.

    Fingerprints at most `distance` bits apart are linked, those of empty texts (zero) like any other. Equal
    fingerprints are one node, so copies never multiply. A row without a doc_id gets its fingerprint, takes no
    part in the linking and has a null component_id. An empty table gives an empty table.

    A bucket holds distinct fingerprints that agree on half of the bits' tables. Buckets of more than WIDE are
    dealt anew by three quarters of the bits; there at most 2**16 different fingerprints can meet, which look their
    neighbours up. A fingerprint that many rows share meets its component in an outer join, which splits such keys.
    """
    prints = cut(fingerprints(docs, id_col, text_col, words))
    nodes = cut(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    groups = connected_components(links_within(nodes, distance))
    of = nodes.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = prints.join(of, "fp", "left")
    return out.select("doc_id", hex64("fp").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _other(name: str, columns: list[str]) -> str:
    """name, or a longer one that is not among the columns."""
    while name.lower() in [c.lower() for c in columns]:
        name += "_"
    return name


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2) -> DataFrame:
    """One row, with all its columns, of each group of near-copies: the one of the smallest doc_id.

    Near-copies are linked by a Jaccard similarity of at least 0.8 on five-word shingles, over any number of steps: SimHash
    fingerprints of the shingles at most `distance` bits apart, found by their pivot distance tables, are verified
    exactly, and near_copies adds the links that such fingerprints can't reach. Rows without a doc_id are members like
    any other and stay only where no other member has one; ties go to the smaller hash of the text, and of rows equal in
    doc_id and text any one stays. A null text is empty; texts without words are copies of each other. An empty table
    gives an empty table.
    """
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keys = cut(near_copies.keyed(given))
    order = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("doc_id"), F.col("hash").alias("hash"))
    nodes = cut(keys.groupBy("node").agg(F.min("hash").alias("hash"), F.min("size").alias("size"), F.min("fp").alias("fp"), F.min("blocks").alias("blocks"), F.min(order).alias("first")))
    same = links_within(nodes.where("size > 0").groupBy("fp").agg(F.min("node").alias("node")), distance)
    stars = nodes.where("size > 0").select("fp", "node").join(nodes.where("size > 0").groupBy("fp").agg(F.min("node").alias("hub")), "fp").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    groups = near_copies.components(given.select("text"), nodes, same.union(stars))
    kept = nodes.join(groups, "node", "left").groupBy(F.coalesce("component", "node").alias("group")).agg(F.min("first").alias("first")).select("first.doc_id", "first.hash")
    counted = keys.groupBy("doc_id", "hash").agg(F.count("*").alias("n")).alias("x")
    is_kept = F.col("y.hash").isNotNull()
    counted = counted.join(kept.alias("y"), F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.hash") == F.col("y.hash")), "left").select("x.doc_id", "x.hash", is_kept.alias("repeated"), F.col("n") > 1)
    gone = cut(counted.toDF("doc_id", "hash", "kept", "several").where("not kept or several"))  # rows that don't stay as they are
    number = _other("hash", docs.columns)
    rows = docs.withColumn(number, hashed)
    gone_id, gone_hash = F.col("gone.doc_id"), F.col("gone.hash")
    meet = rows[id_col].cast("long").eqNullSafe(gone_id) & (rows[number] == gone_hash)
    listed = lambda df: (F.broadcast(df) if df.count() <= near_copies.BROADCAST else df).alias("gone")
    out = rows.join(listed(gone), meet, "left_anti")
    several = gone.where("kept")
    if not several.isEmpty():
        out = out.unionByName(rows.join(listed(several), meet, "left_semi").dropDuplicates([id_col, number]))
    drop(keys, nodes, groups)
    return out.select(docs.columns)
