"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, filtered, per_batch, texts
from .weak import logistic, posterior

#: Words that vote for toxicity from the start.
LEXICON = ("bastard", "clown", "crap", "disgusting", "dumb", "filth", "fool", "idiot", "idiotic", "imbecile", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless")
#: Beginnings of words, by length, that may become pattern voters; whole words may too. A beginning counts
#: anew when two and when three different words of a text have it.
BEGINNINGS = (4, 5, 6, 7)
#: Labelled rows that the model is fitted on, of each label at most.
SAMPLE = {1: 3000, 0: 6000}
#: Candidate patterns, the least standardised difference of their rates, and the toxic rows, in number and as a share
#: of all, that have one at least. Patterns are taken until no more rows lack COVER of them.
PATTERNS, APART, ROWS, SHARE, COVER = 1500, 4.0, 3, 0.015, 3

_WORD = re.compile(r"[^\W\d_]+")


_MORE = 1 << 32


def _id(kind: int, text: str) -> int:
    return kind << 32 | zlib.crc32(text.encode())


def word_ids(word: str) -> tuple[int, ...]:
    """The ids of a lower-case word: itself (kind 0) and its beginnings (kind: four times their length)."""
    return (_id(0, word), *(_id(4 * k, word[:k]) for k in BEGINNINGS if len(word) > k))


def with_counts(ids: Iterable[int]) -> set[int]:
    """The ids, and for those that occur twice and thrice the ids of the next kinds."""
    out: set[int] = set()
    for i in ids:
        if i not in out:
            out.add(i)
        elif i + _MORE not in out:
            out.add(i + _MORE)
        else:
            out.add(i + 2 * _MORE)
    return out


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


@dataclass
class Model:
    """score = 1 / (1 + exp(-(bias + weights of the patterns present + weight of their number)))."""

    weights: dict[int, float] = field(default_factory=lambda: {_id(0, w): 2.0 for w in LEXICON})
    #: For 0, 1, 2 and 3 or more patterns.
    number: tuple[float, ...] = (-2.0, 0.0, 1.0, 2.0)
    bias: float = -2.0

    def score(self, ids: set[int]) -> float:
        z = self.bias + sum(self.weights[i] for i in sorted(ids)) + self.number[min(len(ids), 3)]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _number(counts: np.ndarray) -> np.ndarray:
    return (np.minimum(counts, 3)[:, None] == np.arange(4)).astype(float)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fitted on at most SAMPLE labelled rows that aren't held out, those of the smallest hashes.

    Of several texts of one doc_id the one of the smallest hash counts, of several labels the toxic one; null ids and
    labels don't count. The voters' rates are counted by Spark; the driver gets the PATTERNS best ones and, for each
    sampled row, which of them it has. Without labelled rows of both kinds the lexicon alone decides.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out("doc_id"))
    parts = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in SAMPLE.items()]
    chosen = F.broadcast(parts[0].union(parts[1]))  # at most the sum of SAMPLE
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).join(chosen, "doc_id")
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [sorted(with_counts(i for w in words_of(t) for i in word_ids(w))) for t in texts(batch, "text")]
            return pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([xxhash.xxh128_digest(np.array(x, np.int64).tobytes()) for x in ids], pa.binary()), pa.array(ids, pa.list_(pa.int64()))], ["toxic", "same", "ids"])

        return step

    # rows of the same words count once
    rows = cut(per_batch(rows.select("toxic", "text"), "toxic int, same binary, ids array<long>", make).dropDuplicates(["toxic", "same"]))
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return Model()
    counts = rows.select("toxic", F.explode("ids").alias("id")).groupBy("id").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    rate = F.col("n") / (toxic + clean)
    apart = (F.col("t") / toxic - (F.col("n") - F.col("t")) / clean) / F.sqrt(rate * (1 - rate) * (1 / toxic + 1 / clean) + 1e-12)
    precise = (F.col("t") / toxic) > 10 * (F.col("n") - F.col("t") + 0.1) / clean
    found = counts.where((F.col("t") >= max(ROWS, SHARE * toxic)) & precise).withColumn("z", apart).where(F.col("z") >= APART).orderBy(F.desc("z"), "id").limit(PATTERNS).select("id").collect()
    lexicon = [_id(0, w) for w in LEXICON]
    patterns = list(dict.fromkeys([*lexicon, *(r["id"] for r in found)]))
    place = {p: k for k, p in enumerate(patterns)}
    sample = rows.select("toxic", "same", F.array_intersect("ids", F.array(*map(F.lit, patterns))).alias("hits")).orderBy("toxic", "same").collect()
    y, x = np.array([r["toxic"] for r in sample], float), np.zeros((len(sample), len(patterns)))
    for k, r in enumerate(sample):
        x[k, [place[i] for i in r["hits"]]] = 1
    kept = _covering(x, y, len(lexicon))
    patterns, x = [patterns[k] for k in kept], x[:, kept]
    number = x.sum(axis=1)
    votes = np.concatenate([np.where(x > 0, 1, -1), np.where(number == 0, 0, -1)[:, None], np.where(number >= 2, 1, -1)[:, None], np.where(number >= 4, 1, -1)[:, None]], axis=1)
    labels_of, *_ = posterior(votes, y.mean(), np.clip(y, 0.05, 0.95))
    w, b = logistic(np.concatenate([x, _number(number)], axis=1), labels_of)
    return Model(dict(zip(patterns, w[: len(patterns)].tolist())), tuple(w[len(patterns) :].tolist()), b)


def _covering(x: np.ndarray, y: np.ndarray, given: int) -> list[int]:
    """The first `given` patterns, and of the others always the one that the most toxic rows lack, less the clean rows that have it."""
    toxic, clean = x[y == 1], x[y == 0]
    cover, kept, fault = toxic[:, :given].sum(axis=1), list(range(given)), 5 * clean.sum(axis=0) * max(1, len(toxic)) / max(1, len(clean))
    while True:
        gain = toxic[cover < COVER].sum(axis=0) - fault
        gain[kept] = 0
        best = int(gain.argmax())
        if gain[best] < max(ROWS, SHARE * len(toxic)):
            return kept
        kept.append(best)
        cover = cover + toxic[:, best]


def _scorer(model: Model) -> Callable[[list[str]], np.ndarray]:
    known: dict[str, tuple[int, ...]] = {}
    near = {i - k * _MORE for i in model.weights for k in range(3 if i >> 32 else 1)}

    def scores(given: list[str]) -> np.ndarray:
        out = []
        for t in given:
            hits: list[int] = []
            for w in words_of(t):
                if (ids := known.get(w)) is None:
                    if len(known) > 300_000:
                        known.clear()
                    ids = known[w] = tuple(i for i in word_ids(w) if i in near)
                if ids:
                    hits.extend(ids)
            out.append(model.score(with_counts(hits) & model.weights.keys()))
        return np.array(out)

    return scores


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row from its whole text alone; null texts are empty, an empty text has a score too.

    Null ids and repeated rows are kept, an empty table gives an empty table.
    """

    def make():
        scores = _scorer(model)
        return lambda batch: pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(texts(batch, "text")), pa.float64())], ["doc_id", "score"])

    return per_batch(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), f"doc_id {dict(docs.dtypes)[id_col]}, score double", make)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that score below the threshold; no row is shuffled.

    A null text is empty; rows with equal texts stay or go together, whatever their ids. An empty table gives an empty
    table, empty labels the lexicon's model.
    """
    model = fit(docs, labels, id_col, text_col)

    def make():
        scores = _scorer(model)
        return lambda given: scores(given) < threshold

    return filtered(docs, text_col, make)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Rows with equal texts get equal scores. A null doc_id is scored and not held out. An empty table gives an
    empty table, empty labels the lexicon's model.
    """
    out = score(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
