"""Secret scans: fixed patterns, and two Markov models of characters compared by their log-likelihood ratio."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, per_batch, place, texts

#: Fixed patterns, the group that counts, and its least length.
BASE = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
KINDS = (*BASE, "random")
#: Finds all matches of the pattern `hex` that are long enough, and no others.
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_WORD = re.compile(r"[A-Za-z][a-z]{2,30}")
#: Characters of a span of the models at least.
LEAST = 16
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

#: Characters of the models; anything else ends a string.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = {c: k for k, c in enumerate(ALPHABET)}
#: Texts whose words are the samples labelled ordinary (those of the smallest hashes), strings labelled random.
SAMPLE, RANDOM = 2000, 4000
#: Least log-likelihood ratio of a span, in all and by character.
TOTAL, EACH = 14.0, 0.5

_RANDOM_KINDS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")


@dataclass
class Model:
    """ratio[a, b]: log-likelihood ratio of character b after a, random over ordinary."""

    ratio: np.ndarray

    def of(self, text: str) -> float:
        codes = [_CODE[c] for c in text]
        return float(self.ratio[codes[:-1], codes[1:]].sum())


def _transitions(strings: list[str]) -> np.ndarray:
    n = len(ALPHABET)
    counts = np.zeros(n * n, np.int64)
    joined = "\0".join(strings)
    codes = np.array([_CODE.get(chr(k), -1) for k in range(128)])[np.frombuffer(joined.encode("ascii"), np.uint8)]
    a, b = codes[:-1], codes[1:]
    inside = (a >= 0) & (b >= 0)
    np.add.at(counts, a[inside] * n + b[inside], 1)
    return counts.reshape(n, n)


def _probability(counts: np.ndarray) -> np.ndarray:
    return (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)


def random_strings(n: int = RANDOM) -> list[str]:
    """Samples labelled random: keys of the usual alphabets, from a fixed seed."""
    rng = np.random.default_rng(17)
    return ["".join(rng.choice(list(_RANDOM_KINDS[k % len(_RANDOM_KINDS)]), int(rng.integers(16, 65)))) for k in range(n)]


def identifiers(words: list[str]) -> list[str]:
    """Samples labelled ordinary: the words, and names that join two or three of them, with a number now and then."""
    out = list(words)
    for k in range(0, len(words) - 2, 3):
        a, b, c = words[k : k + 3]
        out += [f"{a}_{b}_{c}".lower(), f"{a}-{b}".lower(), a.lower() + b.capitalize() + c.capitalize(), f"{a}_{b}".upper(), f"{a}{k % 100}", f"{a}/{b}/{c}".lower()]
    return out


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Counts the transitions of ordinary strings by Spark in at most SAMPLE different texts, whatever the rows' ids; the driver gets their sums.

    With no texts all ordinary transitions are alike.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = docs.select(F.xxhash64(text).alias("h")).distinct().orderBy("h").limit(SAMPLE)
    rows = docs.select(F.xxhash64(text).alias("h"), text.alias("text")).join(F.broadcast(some), "h").dropDuplicates(["h"]).select("text")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = np.zeros((len(ALPHABET), len(ALPHABET)), np.int64)
            for t in texts(batch, "text"):
                for pattern, group, least in BASE.values():
                    t = pattern.sub(lambda m: " " if len(m[group]) >= least else m[0], t)  # noqa: B023
                counts += _transitions(identifiers(list(dict.fromkeys(_WORD.findall(t)))))
            a, b = np.nonzero(counts)
            return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts[a, b])], ["a", "b", "n"])

        return step

    ordinary = np.zeros((len(ALPHABET), len(ALPHABET)))
    for r in per_batch(rows, "a int, b int, n long", make).groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        ordinary[r["a"], r["b"]] = r["n"]
    return Model(np.log(_probability(_transitions(random_strings()))) - np.log(_probability(ordinary)))


Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    out = []
    for kind, (pattern, group, least) in BASE.items():
        if kind == "access" and "AKIA" not in text:
            continue
        found = (_LONG_HEX if kind == "hex" else pattern).finditer(text)
        out += [(kind, m.start(), m.end()) for m in found if m.end(group) - m.start(group) >= least]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def all_spans(text: str, model: Model, base: list[Span]) -> list[Span]:
    """The base spans and those of the models, which never touch a base span: of a run that does, the rest is judged part by part."""
    out = list(base)
    for m in _CANDIDATE.finditer(text):
        x, y = m.span()
        parts = []
        for _, s, e in base:
            if x < e and s < y:
                parts.append((x, s))
                x = max(x, e)
        for a, b in [*parts, (x, y)]:
            if b - a >= LEAST and (ratio := model.of(text[a:b])) >= TOTAL and ratio >= EACH * (b - a):
                out.append(("random", a, b))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _shown(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row, over its whole text.

    Positions are code points, ends are exclusive. A null text is empty and has no spans (the digest is that of
    the empty string). Equal texts give equal spans; null doc_ids and repeated rows are kept.
    """
    model = fit(docs, text_col)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, digests, spans = [], [], []
            for t in texts(batch, "text"):
                base = base_spans(t)
                counts.append([sum(k == kind for k, *_ in base) for kind in BASE])
                digests.append(hashlib.sha256(_shown(base).encode()).hexdigest())
                spans.append(_shown(all_spans(t, model, base)))
            n = np.array(counts, np.int64)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(n[:, k]) for k in range(3)), pa.array(digests), pa.array(spans)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

        return step

    return per_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", make)


def masked(text: str, spans: list[Span], mask: str = "[SECRET]") -> str:
    """The text with every span, or run of overlapping spans, replaced by the mask."""
    out, at = [], 0
    for _, s, e in spans:
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of docs, with the secrets masked in the text; a null text stays null. Needs a string column text_col.

    Of columns whose names differ in case alone the one spelled text_col counts. Null ids and repeated rows are kept, an
    empty table gives an empty table.
    """
    at = place(docs.columns, text_col)
    model = fit(column(docs, text_col))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            new = [None if t is None else masked(t, all_spans(t, model, base_spans(t))) for t in batch.column(at).to_pylist()]
            return batch.set_column(at, batch.schema.field(at).name, pa.array(new, pa.string()))

        return step

    return per_batch(docs, docs.schema, make)
