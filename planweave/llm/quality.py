"""Quality by weak labels: heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, filtered, per_batch, texts
from .weak import logistic, posterior

#: Buckets of the hashed features; rows that the scorer is fitted on at most, those of the smallest hashes.
BUCKETS, SAMPLE = 4096, 6000
#: Assumed share of good rows before any vote.
PRIOR = 0.75
#: Kept from this score on.
KEEP = 0.5

_SHAPES = ((re.compile(r"[^\W\d_]*[^\W\d_A-Z][^\W\d_]*"), "a"), (re.compile(r"[A-Z]{2,}"), "A"), (re.compile(r"\d+"), "0"))
_RUN = re.compile(r"(.)\1+")
_LETTER, _CAPITAL, _DIGIT, _SYMBOL = re.compile(r"[^\W\d_]+"), re.compile("[A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+"), re.compile(r"[^\w\s.,]+")


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def shape(word: str) -> str:
    """Letters, capitals and digits as one character each; runs of other characters as two."""
    for pattern, to in _SHAPES:
        word = pattern.sub(to, word)
    return _RUN.sub(r"\1\1", word)


def steps(value: float) -> int:
    """How many features a statistic sets: ten for each unit up to 2, beyond it four for each doubling."""
    return int(10 * value) if value <= 2 else 20 + int(4 * np.log2(value / 2))


@cache
def _step(name: str, n: int) -> int:
    return _bucket(f"{name}:{n}")


@cache
def _kinds() -> np.ndarray:
    """By code point: 1 for letters, 2 more for capitals, 4 for symbols, 8 for digits."""
    every = "".join(map(chr, (k for k in range(0x110000) if not 0xD800 <= k < 0xE000)))
    place = np.frombuffer(every.encode("utf-32-le"), np.uint32)
    out = np.zeros(0x110000, np.uint8)
    for bit, pattern in ((1, _LETTER), (2, _CAPITAL), (4, _SYMBOL), (8, _DIGIT)):
        for m in pattern.finditer(every):
            out[place[m.start() : m.end()]] |= bit
    return out


#: Statistics of a text: words; shares of capitals among letters, of symbols and digits among characters, of words that
#: occurred before, that repeat the word before, that are symbols only, of lines that occurred before; ten characters a
#: word; share of words of unusual shape. FEW words more are counted as ordinary, so that short texts seem ordinary.
STATISTICS = ("words", "capital", "symbol", "digit", "repeated", "again", "bare", "lines", "length", "odd")
FEW = 6
#: Marks of a remembered word beside its bucket: only symbols, an ordinary shape.
_BARE, _PLAIN = 1 << 20, 1 << 21


class Reader:
    """Hashed features and statistics of texts; remembers the shapes of words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.plain = {_bucket(f"shape:{s}") for s in ("a", "a.", "a,", "A", "A.", "A,", "0")}
        self.kinds = _kinds()

    def _of(self, words: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        except KeyError:
            if len(self.known) > 300_000:
                self.known.clear()
            for w in set(words):
                if w not in self.known:
                    at = _bucket("shape:" + shape(w))
                    bare = len(w) < 4 and not _LETTER.search(w) and not _DIGIT.search(w)
                    self.known[w] = at | _BARE * bare | _PLAIN * (at in self.plain)
            return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(buckets of the words, buckets of what the statistics set, statistics)."""
        words = text.split()
        n, chars = len(words), len(text)
        of = self._of(words)
        count = np.bincount(self.kinds[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=16)
        letters, capitals, symbols, digits = (int(count[[k for k in range(16) if k & bit]].sum()) for bit in (1, 2, 4, 8))
        lines = [t for t in text.split("\n") if t.strip()]
        s = np.array([
            n, capitals / (letters + 5 * FEW), symbols / (chars + 10 * FEW), digits / (chars + 20 * FEW), 1 - len(set(words)) / max(1, n),
            sum(map(str.__eq__, words, words[1:])) / (n + FEW), np.count_nonzero(of & _BARE) / (n + FEW),
            (len(lines) - len(set(lines))) / (len(lines) + 1), chars / (n + 1) / 10, 1 - (np.count_nonzero(of & _PLAIN) + FEW) / (n + FEW),
        ])
        return of & (BUCKETS - 1), np.array([_step(name, k) for name, value in zip(STATISTICS[1:], s[1:].tolist()) for k in range(1, steps(value) + 1)], np.int64), s

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(buckets, values, statistics): the share of words, FEW more counted, and 1 for each step."""
        of, more, s = self.read(text)
        x = np.bincount(of, minlength=BUCKETS) / (len(of) + FEW) + np.bincount(more, minlength=BUCKETS)
        at = np.flatnonzero(x)
        return at, x[at], s


def votes(s: np.ndarray) -> np.ndarray:
    """Labellers by column, for statistics by row: 1 good, 0 bad, -1 abstains."""
    v = dict(zip(STATISTICS, s.T))
    many = v["words"] >= 12
    bad = [
        v["capital"] > 0.3, v["symbol"] > 0.08, v["symbol"] > 0.15, v["digit"] > 0.3, many & (v["repeated"] > 0.65), many & (v["again"] > 0.25),
        v["bare"] > 0.1, many & (v["lines"] > 0.5), v["odd"] > 0.4, v["length"] > 1.5,
    ]
    varied = (v["repeated"] < 0.6) & (v["again"] < 0.15)
    good = [
        varied & (v["capital"] < 0.1) & (v["symbol"] < 0.04), varied & (v["odd"] < 0.25) & (v["bare"] < 0.03), varied & (v["length"] < 0.9) & (v["symbol"] < 0.04),
    ]
    return np.stack([*(np.where(b, 0, -1) for b in bad), *(np.where(g, 1, -1) for g in good)], axis=1)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    accuracies: np.ndarray

    def score(self, reader: Reader, text: str) -> float:
        of, more, _ = reader.read(text)
        z = self.weights[of].sum() / (len(of) + FEW) + self.weights[more].sum() + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Fitted without labels on at most SAMPLE different texts, those of the smallest hashes, whatever the rows' ids.

    A null text is empty. An empty table gives a model that keeps everything.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = docs.select(F.xxhash64(text).alias("h")).distinct().orderBy("h").limit(SAMPLE)
    rows = docs.select(F.xxhash64(text).alias("h"), text.alias("text")).join(F.broadcast(some), "h")

    def make():
        reader = Reader()
        seen: set[int] = set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            new = {h: t for h, t in zip(batch.column("h").to_pylist(), texts(batch, "text")) if h not in seen}
            seen.update(new)
            read = [reader.features(t) for t in new.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), pa.array([a for a, _, _ in read], pa.list_(pa.int32())), pa.array([x for _, x, _ in read], pa.list_(pa.float32())), pa.array([s for _, _, s in read], pa.list_(pa.float64()))], ["h", "at", "x", "s"])

        return step

    sample = per_batch(rows, "h long, at array<int>, x array<float>, s array<double>", make).dropDuplicates(["h"]).orderBy("h").collect()
    if not sample:
        return Model(np.zeros(BUCKETS), 5.0, np.zeros(0))
    x, s = np.zeros((len(sample), BUCKETS)), np.array([r["s"] for r in sample])
    for k, r in enumerate(sample):
        x[k, r["at"]] = r["x"]
    v = votes(s)
    start = np.where((v == 0).any(axis=1), 0.02, 0.95)
    p, accuracies, _ = posterior(v, PRIOR, start)
    seen, w = np.flatnonzero((x > 0).sum(axis=0) > 1), np.zeros(BUCKETS)
    w[seen], b = logistic(x[:, seen], p, penalty=1e-4, rounds=300)
    return Model(w, b, accuracies)


def _scorer(model: Model) -> Callable[[list[str]], np.ndarray]:
    reader = Reader()
    return lambda given: np.array([model.score(reader, t) for t in given])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row from its whole text; a null text is empty, an empty table gives an empty table. Null ids and repeated rows are kept."""

    def make():
        scores = _scorer(model)
        return lambda batch: pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(texts(batch, "text")), pa.float64())], ["doc_id", "score"])

    return per_batch(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), f"doc_id {dict(docs.dtypes)[id_col]}, score double", make)


def good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that score KEEP or more; no row is shuffled.

    A null text is empty; rows with equal texts stay or go together, whatever their ids. An empty table gives an empty table.
    """
    model = fit(column(docs, text_col))

    def make():
        scores = _scorer(model)
        return lambda given: scores(given) >= KEEP

    return filtered(docs, text_col, make)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, keep) of every row: score near 1 is good text, keep is 1 from KEEP on.

    Rows with equal texts get equal scores; repeated rows and null doc_ids are scored like any other.
    """
    out = score(docs, fit(docs, text_col), id_col, text_col)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "score", (F.col("score") >= KEEP).cast("int").alias("keep"))
