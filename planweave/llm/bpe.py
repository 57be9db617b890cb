"""Byte-level BPE encoding and decoding, merged by recursive queries of an in-process DuckDB in each partition."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, held, per_batch, slices

#: Chunks of text of a generation that a worker remembers, and bytes of text that it takes at once (or one longer text).
REMEMBERED, SLICE = 300_000, 2**22
#: Bytes of the words that one recursive query merges, of the longest word among them, and rows that a query may make of a longer one.
AT_ONCE, SHORT, ROWS = 200_000, 64, 2_000_000

_SPACE = r"\t-\r \x85\xa0  -     　"
#: A run of other characters with at most one space before it, or white space: no match of the pattern crosses these.
_CHUNK = regex.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: White space before a space: splitting at single spaces would then part a run of white space. NUL is a mark here.
_ODD = rf"[{_SPACE}] |\x00"
#: Letters in any Unicode version, as a class.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"

#: How the usual pattern begins, and the letters that are so in any Unicode version.
_USUAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|"
_PLAIN, _STOPS = regex.compile(r"[\0-\u024f]+"), {".", ","}

#: `state` holds token-position rows: k is the word's number and the position, 32 bits each. A step joins neighbours
#: to the merge table, takes each word's leftmost pair of the smallest rank and contracts it; words without a pair
#: fall out, so a word's last step is its fixpoint.
_MERGE = """
WITH RECURSIVE state(k, tok, step) AS (
    SELECT k, tok, 0 FROM start
  UNION ALL
    SELECT s.k - (s.k > best.k)::BIGINT, CASE WHEN s.k = best.k THEN best.made ELSE s.tok END, s.step + 1
    FROM state s JOIN (
      SELECT w, (w << 32) | (low & 4294967295) AS k, (low >> 32)::INTEGER AS made
      FROM (
        SELECT l.k >> 32 AS w, min((m.made::BIGINT << 32) | (l.k & 4294967295)) AS low
        FROM state l JOIN state r ON r.k = l.k + 1 JOIN merges m ON m.pair = ((l.tok::BIGINT << 32) | r.tok)
        GROUP BY l.k >> 32
      )
    ) best ON best.w = s.k >> 32
    WHERE s.k <> best.k + 1
)
SELECT s.k, s.tok
FROM state s JOIN (SELECT k >> 32 AS w, max(step) AS step FROM state GROUP BY 1) last ON last.w = s.k >> 32 AND last.step = s.step
"""
#: The same for one long word and a number of steps. Where no pair that holds the new token ranks before it (`quiet`),
#: the other places of the best pair would be next, so a step contracts them all: of overlapping ones every other, from the left.
_MERGE_LONG = """
WITH RECURSIVE state(k, tok, step) AS (
    SELECT k, tok, 0 FROM start
  UNION ALL (
    WITH pairs AS (
      SELECT l.k, m.made, m.quiet
      FROM state l JOIN state r ON r.k = l.k + 1 JOIN merges m ON m.pair = ((l.tok::BIGINT << 32) | r.tok)
    ), best AS (
      SELECT k, made FROM pairs WHERE made = (SELECT min(made) FROM pairs) AND (quiet OR k = (SELECT min(k) FROM pairs WHERE made = (SELECT min(made) FROM pairs)))
    ), runs AS (
      SELECT k, made, k - row_number() OVER (ORDER BY k) AS run FROM best
    ), hits AS (
      SELECT k, made FROM (SELECT k, made, k - min(k) OVER (PARTITION BY run) AS place FROM runs) WHERE place % 2 = 0
    ), marked AS (
      SELECT s.k, s.tok, s.step, h.made, count(h.made) OVER (ORDER BY s.k) AS hits, lag(h.made) OVER (ORDER BY s.k) AS before
      FROM state s LEFT JOIN hits h ON h.k = s.k
    )
    SELECT k - hits + (made IS NOT NULL)::BIGINT, coalesce(made, tok), step + 1 FROM marked
    WHERE before IS NULL AND step < {steps} AND EXISTS (SELECT 1 FROM hits)
  )
)
SELECT k, tok, step FROM state WHERE step = (SELECT max(step) FROM state)
"""
#: Ids to bytes, whichever way they came: positions join the vocabulary, its texts are aggregated in order.
_DECODE = """
SELECT w, string_agg(CASE WHEN hex IS NULL THEN error('no such id: ' || tok) ELSE hex END, '' ORDER BY p) AS bytes
FROM {rows} LEFT JOIN vocabulary USING (tok) GROUP BY w
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def database(ranks: dict[bytes, int]):
    """A DuckDB that holds the vocabulary, in bounded memory and without files of its own."""
    import duckdb

    db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
    give(db, "vocabulary", pa.table({"tok": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]}))
    return db


def give(db, name: str, rows: pa.Table) -> None:
    db.register("given", rows)
    db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
    db.unregister("given")


class Merger:
    """Ids and decoded bytes of texts. DuckDB holds the merge table and the vocabulary; each different chunk is merged and decoded once and remembered by a number."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        self.ranks, self.pattern = load_ranks(path), regex.compile(pattern)
        self.usual = pattern.startswith(_USUAL)
        self.single = np.array([self.ranks[bytes([k])] for k in range(256)], np.int32)
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], rank) for t, rank in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        left, right, made = (np.array(x, np.int64) for x in zip(*pairs))
        first = np.full(max(self.ranks.values()) + 1, np.iinfo(np.int64).max)  # the smallest rank that a token is merged into
        np.minimum.at(first, left, made)
        np.minimum.at(first, right, made)
        self.db = database(self.ranks)
        give(self.db, "merges", pa.table({"pair": left << 32 | right, "made": made.astype(np.int32), "quiet": first[made] > made}))
        #: Whether two bytes are neighbours in any token; no merge crosses others.
        self.near = np.zeros(2**16, bool)
        for t in self.ranks:
            self.near[[x << 8 | y for x, y in zip(t, t[1:])]] = True
        self.chunks = Remembered(("<u4", "u1"), remembered, self._made)

    def _merged(self, part: list[bytes]) -> pa.Table:
        """(k, tok): the ids of short words."""
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        flat = np.frombuffer(b"".join(part), np.uint8)
        position = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        give(self.db, "start", pa.table({"k": np.repeat(np.arange(len(part)), lengths) << 32 | position, "tok": self.single[flat]}))
        return self.db.sql(_MERGE).to_arrow_table()

    def _long(self, word: bytes) -> np.ndarray:
        """The ids of a word of any length: so many steps a query that its rows stay bounded."""
        tok, steps = self.single[np.frombuffer(word, np.uint8)], 0
        while True:
            limit = max(1, ROWS // len(tok))
            give(self.db, "start", pa.table({"k": np.arange(len(tok)), "tok": tok}))
            done = self.db.sql(_MERGE_LONG.format(steps=limit)).to_arrow_table()
            tok, steps = done.column("tok").to_numpy()[np.argsort(done.column("k").to_numpy())], done.column("step")[0].as_py()
            if steps < limit:
                return tok

    def merge(self, words: list[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """(ids, decoded bytes) of non-empty words; those in the vocabulary need no step. What is decoded are the ids."""
        out: dict[bytes, tuple[bytes, bytes]] = {}
        whole, short, long = [], [], []
        for w in words:
            (whole if w in self.ranks else short if len(w) <= SHORT else long).append(w)
        # words beyond SHORT bytes are cut where no merge crosses
        cuts = {w: self._cuts(w) for w in long}
        parts = {x for xs in cuts.values() for x in xs}
        short += [x for x in parts if x not in self.ranks and len(x) <= SHORT]
        whole += [x for x in parts if x in self.ranks]
        short, whole = list(dict.fromkeys(short)), list(dict.fromkeys(whole))
        sizes = np.cumsum([len(w) for w in short])
        edges = [0, *np.flatnonzero(np.diff(sizes // AT_ONCE, append=-1)) + 1] if short else [0]
        for a, b in zip(edges, edges[1:]):
            self._decode(short[a:b], self._merged(short[a:b]), out)
        for a in range(0, len(whole), AT_ONCE // 4):
            some = whole[a : a + AT_ONCE // 4]
            self._decode(some, pa.table({"k": np.arange(len(some)) << 32, "tok": np.array([self.ranks[w] for w in some], np.int32)}), out)
        for x in parts:
            if x not in out:
                ids = self._long(x)
                self._decode([x], pa.table({"k": np.arange(len(ids)), "tok": ids}), out)
        for w, xs in cuts.items():
            out[w] = (b"".join([out[x][0] for x in xs]), b"".join([out[x][1] for x in xs]))
        return out

    def _cuts(self, word: bytes) -> list[bytes]:
        flat = np.frombuffer(word, np.uint8).astype(np.int64)
        at = [0, *(np.flatnonzero(~self.near[flat[:-1] << 8 | flat[1:]]) + 1).tolist(), len(word)]
        return [word[x:y] for x, y in zip(at, at[1:])]

    def _decode(self, words: list[bytes], rows: pa.Table, out: dict[bytes, tuple[bytes, bytes]]) -> None:
        give(self.db, "merged", rows)
        done = self.db.sql(_DECODE.format(rows="(SELECT k >> 32 AS w, k AS p, tok FROM merged)")).to_arrow_table()
        order = np.argsort(rows.column("k").to_numpy())
        flat, number = rows.column("tok").to_numpy()[order].astype("<u4").tobytes(), rows.column("k").to_numpy()[order] >> 32
        ends = (np.searchsorted(number, np.arange(len(words) + 1)) * 4).tolist()
        for w, text in zip(done.column("w").to_pylist(), done.column("bytes").to_pylist()):
            out[words[w]] = (flat[ends[w] : ends[w + 1]], bytes.fromhex(text))

    def _made(self, new: list[str]) -> list[list[bytes]]:
        """Ids and decoded bytes: a chunk is joined over its matches of the pattern. It stands for itself after a space, or after NUL for itself alone."""
        matched = [self._letters(c) or [m.encode() for m in self.pattern.findall(c[1:] if c[:1] == "\0" else " " + c)] for c in new]
        done = self.merge(list({w for words in matched for w in words}))
        return [[done[words[0]][side] if len(words) == 1 else b"".join([done[w][side] for w in words]) for words in matched] for side in (0, 1)]

    def _letters(self, chunk: str) -> list[bytes] | None:
        """The matches in the two usual chunks, if the pattern is one that keeps runs of letters together with the space before."""
        if not self.usual:
            return None
        if chunk.isalpha() and _PLAIN.fullmatch(chunk):
            return [b" " + chunk.encode()]
        if chunk[-1:] in _STOPS and chunk[:-1].isalpha() and _PLAIN.fullmatch(chunk):
            return [b" " + chunk[:-1].encode(), chunk[-1].encode()]
        return None

    def encode(self, given: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each text's end, decoded bytes, where each text's end), all texts one after another; ends from 0 on."""
        parts = chunks(given, self.usual)
        coded, ends = parts.flatten().dictionary_encode(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
        number = self.chunks.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        (ids, to), (decoded, till) = (rows.gather(number) for rows in self.chunks.rows)
        return ids, np.concatenate([[0], to])[ends], decoded, np.concatenate([[0], till])[ends]


def chunks(given: pa.Array, usual: bool = False) -> pa.Array:
    """Each text in parts that no match of the pattern crosses; a part that no space stands before is marked by a NUL.

    The usual pattern also parts letters from one full stop or comma before a space, and both from a line end.
    """
    odd = pc.match_substring_regex(given, _ODD).to_numpy(zero_copy_only=False)
    if odd.any():
        marked = pa.array([["\0" + c for c in _CHUNK.findall(t)] for t in given.filter(pa.array(odd)).to_pylist()], pa.list_(pa.large_string()))
        both = pa.concat_arrays([chunks(given.filter(pa.array(~odd)), usual), marked])
        return both.take(pa.array(np.argsort(np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]))))
    if usual:
        given = pc.replace_substring_regex(given, f"([{_LETTER}])([.,]) ", "\\1 \0\\2 ")
        given = pc.replace_substring_regex(given, f"([{_LETTER}])([.,]?)\n([{_LETTER}])", "\\1 \0\\2\n \0\\3")
    empty = pa.scalar("", pa.large_string())
    return pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\0", pa.large_string()), given, empty), " ")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<long>, decoded binary) of every whole text.

    A null text is empty and has no ids. Repeated rows and null doc_ids are kept. An empty table gives an empty
    table. Other columns are not looked at.
    """

    def rows(merger: Merger, texts: pa.Array) -> list[pa.Array]:
        ids, to, decoded, ends = merger.encode(texts)
        at = memoryview(decoded)
        return [pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(ids.astype(np.int64))), pa.array([at[x:y] for x, y in zip(ends.tolist(), ends[1:].tolist())], pa.binary())]

    return _each(docs, path, pattern, id_col, text_col, "doc_id long, ids array<long>, decoded binary", rows)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode() without the long columns, for comparing corpora."""

    def rows(merger: Merger, texts: pa.Array) -> list[pa.Array]:
        ids, to, decoded, ends = merger.encode(texts)
        shown = lambda flat, at: pa.array([hashlib.sha256(flat[x:y]).hexdigest() for x, y in zip(at.tolist(), at[1:].tolist())], pa.string())
        return [pa.array(np.diff(to)), shown(memoryview(ids.view(np.uint8)), 4 * to), shown(memoryview(decoded), ends)]

    return _each(docs, path, pattern, id_col, text_col, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)


def _each(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, schema: str, rows: Callable[[Merger, pa.Array], list[pa.Array]]) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def make():
        merger = held(__name__, (path, pattern), lambda: Merger(path, pattern))  # loading the vocabulary takes a second

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts = [rows(merger, part) for _, part in slices(batch.column("text"), SLICE)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.concat_arrays(x) for x in zip(*parts))], names)

        return step

    return per_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), schema, make, rows=None)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded binary) of ids: DuckDB joins positions to the vocabulary and aggregates them in order.

    A null or empty list decodes to no bytes; an id outside the vocabulary is an error.
    """

    def make():
        db = database(load_ranks(path))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            db.register("given", pa.table({"k": np.arange(batch.num_rows), "ids": batch.column("ids")}))
            got = db.execute(_DECODE.format(rows="(SELECT k AS w, generate_subscripts(ids, 1) AS p, unnest(ids) AS tok FROM given)")).fetchall()
            out = [b""] * batch.num_rows
            for k, text in got:
                out[k] = bytes.fromhex(text)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "decoded"])

        return step

    return per_batch(encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")), "doc_id long, decoded binary", make, rows=100)
