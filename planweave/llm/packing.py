"""Best-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, cut, held, per_batch, slices

#: The id that ends each document.
END = 1
#: Pieces packed together by one task, and shards whose open sequences are packed again together.
SHARD, SHARDS = 16_384, 64
#: Words of a generation that a worker remembers, and bytes of text that it takes at once (or one longer text).
REMEMBERED, SLICE = 300_000, 2**22
#: Bytes of the longest word merged here; the rank of a pair that does not merge.
WIDTH, _NONE = 64, np.iinfo(np.int32).max

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Words of these characters alone are the same in any Unicode version of the normaliser and the word pattern.
_PLAIN = re.compile("[\0-\u012f\u0131-\u024f]*")
_END, _STOPS = "</w>", {".", ","}
#: Letters in any Unicode version whose lower case is letters alone, as a class.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"


class WordIds:
    """Ids of texts by a tokenizer file of the word-end kind, whose pieces never cross a space.

    Each different word is encoded once and remembered. Plain words are merged here, many at once; any
    other goes through the library, as does everything if the file's settings are not the ones known here.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer, self.words = Tokenizer.from_file(path), Remembered(("<u4",), remembered, lambda words: [self._ids(words)])
        spec = json.loads(self.tokenizer.to_str())
        model, split = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        self.merged_here = kinds == ["NFC", "Replace", "Lowercase"] and split.get("invert") and split.get("behavior") == "Removed" and model.get("end_of_word_suffix") == _END
        if self.merged_here:
            self.pattern, ids = regex.compile(split["pattern"]["Regex"]), model["vocab"]
            pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
            self.factor = max(ids.values()) + 1
            keys = np.array([ids[a] * self.factor + ids[b] for a, b in pairs])
            order = np.argsort(keys)
            self.keys, self.rank = keys[order], order.astype(np.int32)
            self.made = np.array([ids[a + b.removesuffix(_END) + _END * b.endswith(_END)] for a, b in pairs], np.int32)
            shown = _byte_characters()
            self.inner = np.array([ids[c] for c in shown], np.int32)
            self.last = np.array([ids[c + _END] for c in shown], np.int32)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; those outside the merge table get the largest one."""
        key = a.astype(np.int64) * self.factor + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.rank[at], _NONE)

    def _merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of at most WIDTH bytes: in each round every word's leftmost pair of the smallest rank."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        width = int(lengths.max())
        column = np.arange(width)
        tokens = np.full((len(words), width), -1, np.int32)
        inside = column < lengths[:, None]
        flat = np.frombuffer(b"".join(words), np.uint8)
        tokens[inside] = self.inner[flat]
        tokens[np.arange(len(words)), lengths - 1] = self.last[flat[np.cumsum(lengths) - 1]]
        ranks = np.full((len(words), width), _NONE, np.int32)
        ranks[:, :-1] = self._ranks(tokens[:, :-1], tokens[:, 1:])
        rows = np.arange(len(words))
        while len(rows):
            part = ranks[rows]
            at = part.argmin(axis=1)
            best = part[np.arange(len(rows)), at]
            go = best != _NONE
            rows, at, best, part = rows[go], at[go], best[go], part[go]
            if not len(rows):
                break
            take = np.minimum(column + (column > at[:, None]), width - 1)
            t = np.take_along_axis(tokens[rows], take, 1)
            r = np.take_along_axis(part, take, 1)
            t[:, -1], r[:, -1] = np.where(at == width - 1, t[:, -1], -1), _NONE
            own = np.arange(len(rows))
            t[own, at] = self.made[best]
            right = np.where(at + 1 < width, t[own, np.minimum(at + 1, width - 1)], -1)
            r[own, at] = self._ranks(t[own, at], right)
            before = at > 0
            r[own[before], at[before] - 1] = self._ranks(t[own[before], at[before] - 1], t[own[before], at[before]])
            tokens[rows], ranks[rows] = t, r
        counts = (tokens >= 0).sum(axis=1)
        joined, ends = tokens[tokens >= 0].astype("<u4").tobytes(), (np.concatenate([[0], np.cumsum(counts)]) * 4).tolist()
        return [joined[x:y] for x, y in zip(ends, ends[1:])]

    def _plain(self, chunks: list[str]) -> list[bytes]:
        matched = [_letters(c) or [w.encode() for w in self.pattern.findall(c.lower())] for c in chunks]
        words = sorted({w for ws in matched for w in ws}, key=len)
        done: dict[bytes, bytes] = {}
        for k in range(0, len(words), 20_000):
            part = words[k : k + 20_000]
            done.update(zip(part, self._merge(part)))
        return [done[ws[0]] if len(ws) == 1 else b"".join([done[w] for w in ws]) for ws in matched]

    def _ids(self, words: list[str]) -> list[bytes]:
        plain, rest = [], []
        for k, w in enumerate(words):
            (plain if self.merged_here and len(w) <= WIDTH // 2 and (w.isascii() or _PLAIN.fullmatch(w)) and "<" not in w else rest).append(k)
        found = [b""] * len(words)
        for k, ids in zip(plain, self._plain([words[k] for k in plain])):
            found[k] = ids
        for at in range(0, len(rest), 1_000):
            part = rest[at : at + 1_000]
            for k, e in zip(part, self.tokenizer.encode_batch_fast([words[k] for k in part], add_special_tokens=False)):
                found[k] = np.array(e.ids, "<u4").tobytes()
        return found

    def encode(self, given: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, each with END after it, and where each text ends, from 0 on)."""
        if self.merged_here:
            # white space only parts words, so more of it changes nothing: a stop after letters is a word of its own
            given = pc.replace_substring_regex(pc.replace_substring(given, "\n", " "), f"([{_LETTER}])([.,]) ", "\\1 \\2 ")
        words = pc.split_pattern(given, " ")
        coded, ends = words.flatten().dictionary_encode(), words.offsets.to_numpy()[1:] - words.offsets[0].as_py()
        number = self.words.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        ids, to = self.words.rows[0].gather(number)
        # END after the last word of each text
        to = np.concatenate([[0], to])[ends]
        return np.insert(ids, to, END), np.concatenate([[0], to + np.arange(1, len(to) + 1)])


def _letters(chunk: str) -> list[bytes] | None:
    """The matches of the word pattern for the two usual chunks: letters, and letters before one full stop or comma."""
    if chunk.isalpha():
        return [chunk.lower().encode()]
    if chunk[-1:] in _STOPS and chunk[:-1].isalpha():
        return [chunk[:-1].lower().encode(), chunk[-1].encode()]
    return None


def _byte_characters() -> list[str]:
    """The character that stands for each byte in vocabularies of this kind: itself where printable, else the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class BestFit:
    """Open bins by remaining capacity, under a segment tree that knows which capacities occur."""

    def __init__(self, capacity: int):
        self.capacity, self.leaves = capacity, 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used: list[int] = []

    def _mark(self, room: int, change: int) -> None:
        at = room + self.leaves
        while at:
            self.tree[at] += change
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least `length` that an open bin has."""
        tree, at = self.tree, length + self.leaves
        if tree[at]:
            return length
        while at > 1:
            if not at & 1 and tree[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if tree[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for an item of 1 to `capacity`."""
        if (room := self.tightest(length)) is None:
            number, offset = len(self.used), 0
            self.used.append(length)
        else:
            number = self.open[room].pop()
            self._mark(room, -1)
            offset = self.used[number]
            self.used[number] += length
        if left := self.capacity - self.used[number]:
            self.open[left].append(number)
            self._mark(left, 1)
        return number, offset


def _packed(lengths: np.ndarray, order: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    fit = BestFit(capacity)
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, length in zip(order.tolist(), lengths[order].tolist()):
        number[i], offset[i] = fit.place(length)
    return number, offset, fit.used


def _cut(ids: np.ndarray, ends: np.ndarray, capacity: int, first: int) -> tuple[np.ndarray, ...]:
    """Of texts first, first + 1, ... the pieces: text, piece, start, length, ids_crc32."""
    total = np.diff(ends)
    count = -(-total // capacity)
    doc = np.repeat(np.arange(len(total)), count)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = piece * capacity
    length = np.minimum(capacity, total[doc] - start)
    view, at = memoryview(ids).cast("B"), ends[doc] + start
    crc = np.array([zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(at.tolist(), (at + length).tolist())], np.int64)
    return doc + first, piece, start, length, crc


def pieces(docs: DataFrame, path: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and END, cut every `capacity` ids: doc_id, piece, start, length, ids_crc32.

    A null or empty text is END alone. Null doc_ids and repeated rows are kept, an empty table gives an empty table.
    """

    def make():
        words = held(__name__, path, lambda: WordIds(path))  # tasks of a worker share what is remembered

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts = [_cut(*words.encode(part), capacity, at) for at, part in slices(batch.column("text"), SLICE)]
            doc, *columns = (np.concatenate(x) for x in zip(*parts))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "piece", "start", "length", "ids_crc32"])

        return step

    return per_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), PIECES, make, rows=None)


def best_fit(docs: DataFrame, path: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PIECES with sequence_id and offset: best-fit decreasing in shards, then once more over their open sequences.

    Pieces are dealt to shards of about SHARD by a hash of the row and of its place, so any source, copy group or
    repeated row spreads evenly. A shard leaves its unfilled sequences to a second best-fit pass over SHARDS shards,
    which only moves whole sequences; what stays open is at most about one sequence for each SHARD * SHARDS pieces. A
    null or empty text is a document of END alone. Repeated rows and null doc_ids are packed like any other row; equal
    lengths are placed in the order of doc_id and piece, null ids last. An empty table gives an empty table. Other
    columns are not looked at.
    """
    read = cut(pieces(docs, path, capacity, id_col, text_col))  # places in a written table stay as they are
    shards = max(1, read.count() // SHARD)
    dealt = read.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))

    def pack(rows: pa.Table) -> pa.Table:
        piece, length = (rows.column(c).to_numpy() for c in ("piece", "length"))
        doc = rows.column("doc_id").combine_chunks()
        order = np.lexsort((piece, doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_null().to_numpy(zero_copy_only=False), -length))
        number, offset, used = _packed(length, order, capacity)
        for name, values in (("bin", number), ("offset", offset), ("used", np.array(used)[number])):
            rows = rows.append_column(name, pa.array(values, pa.int64()))
        return rows

    packed = cut(dealt.groupBy("shard").applyInArrow(lambda rows: pack(rows), f"{PIECES}, shard long, bin long, offset long, used long"))

    def again(rows: pa.Table) -> pa.Table:
        shard, old, used = (rows.column(c).to_numpy() for c in ("shard", "bin", "used"))
        order = np.lexsort((old, shard, -used))
        number, base, _ = _packed(used, order, capacity)
        first = np.full(number.max() + 1, -1)
        first[number[order[::-1]]] = order[::-1]  # a joint sequence takes the name of its first part
        return pa.table({"shard": shard, "bin": old, "base": base, "to_shard": shard[first[number]], "to_bin": old[first[number]]})

    unfilled = packed.where(F.col("used") < capacity).select("shard", "bin", "used").distinct()
    moved = unfilled.groupBy(F.expr(f"shard div {SHARDS}").alias("g")).applyInArrow(lambda rows: again(rows), "shard long, bin long, base long, to_shard long, to_bin long")
    moved = moved.where("base > 0 or shard <> to_shard or bin <> to_bin")
    out = packed.join(moved, ["shard", "bin"], "left")
    sequence = F.shiftleft(F.coalesce("to_shard", "shard"), 32) + F.coalesce("to_bin", "bin")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))
