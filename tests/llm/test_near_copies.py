"""The near-duplicates stage of the pipeline against brute-force Jaccard groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from planweave.llm import components, near_copies


def slow_groups(texts):
    """For each text the first one of its group: Jaccard similarity of at least 0.8 on five-word shingles, over any number of steps."""
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    a, b = np.nonzero(np.array([[near(x, y) for y in sets] for x in sets]))
    return components.label(len(texts), a, b)


def near_texts(seed=5):
    """Near-copies over a wide span of similarities, a line that many of them hold, exact copies, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    line = [word() for _ in range(12)]
    out = [None, "", " \n", "a b", "A b", "a b c"]
    for _ in range(14):
        base = [word() for _ in range(rng.randint(20, 90))] + line
        out.append(" ".join(base))
        for _ in range(8):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("wide, rounds, common, side", [(64, 4, 8, 512), (2, 2, 1, 3), (2, 0, 8, 2)])
def test_near_duplicates_stage_is_brute_force(spark, monkeypatch, wide, rounds, common, side):
    for name, value in (("WIDE", wide), ("ROUNDS", rounds), ("COMMON", common), ("PARTS", 2), ("SIDE", side)):
        monkeypatch.setattr(near_copies, name, value)
    texts = near_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("node", F.lit("x")).repartition(3)
    kept = corpus_pipeline.near_duplicates_stage(spark, docs, "")
    assert kept.columns == docs.columns
    root = slow_groups(texts)
    assert 14 < len(set(root.tolist())) < len(texts) - 14
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root.tolist()))


def test_block_distances_never_exceed_the_true_one():
    rng = np.random.default_rng(3)
    for n in (1, 20, 5000, 60_000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**64, n // 10, dtype=np.uint64)]))
        x, y, z = (near_copies.blocks(v) for v in (a, b, b[: len(b) // 9]))
        assert near_copies._apart(x, y) <= len(np.setxor1d(a, b)) and near_copies._apart(x, z) <= len(np.setxor1d(a, b[: len(b) // 9]))
        assert n < 20 or near_copies._apart(x, y) > 0.4 * len(np.setxor1d(a, b))
        other = near_copies.blocks(np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)))
        assert n < 20 or near_copies._far(near_copies._apart(x, other), len(a), len(a))  # sets that share nothing are discarded, whatever their size


def test_one_row_of_each_group_whatever_its_ids(spark):
    text, other = "one two three four five six seven", "something else altogether in this row here"
    rows = [(3, text, 1), (5, text, 2), (5, other, 3), (5, other, 4), (None, text, 5), (None, "no id at all", 6), (None, "No id at\tall", 7), (9, None, 8), (10, " ", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Hash int").repartition(3)
    kept = corpus_pipeline.near_duplicates_stage(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], (r["text"] or "").lower().split()) for r in kept.collect()), key=str)
    assert got == sorted([(3, text.split()), (5, other.split()), (None, "no id at all".split()), (9, [])], key=str)


def test_near_duplicates_stage_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert corpus_pipeline.near_duplicates_stage(spark, docs, "").count() == 0
