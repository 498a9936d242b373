"""Byte-level BPE by corpus-level merge replay.

The distinct pieces of the corpus form one vocabulary: each task counts its pieces, Spark adds the counts up and deals
the pieces out by themselves.  In each part of the vocabulary an inverted index from rank to the places where the pair
of that rank stands drives the replay: the least rank that stands anywhere is applied at all its places at once, and
only the pairs that touch a merged place are looked up again and indexed under their new ranks.  A step may make a pair
of lower rank; it is then simply the next to be applied.  Where such a step merged several places of one piece, the
order inside that piece could matter, and the piece is encoded again on its own, one merge at a time.

The pieces with their ids are sent to all tasks, the most frequent ones up to SHARED bytes, and a second pass over the
texts puts their ids together.  So a piece is replayed once for the corpus.  Only pieces beyond SHARED bytes, which are
the rarest, are replayed where they are met; a worker keeps up to VOCABULARY bytes of those.  Texts are read twice and
never shuffled.  The rank table (under 1 MB for 50,000 tokens) is broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import chunks, durable, pick, ragged

_NONE = np.int32(2**31 - 1)
#: Bytes of text or pieces taken together; characters from which a text is taken in parts, of so many pieces; ids in a
#: batch of the output.
CHUNK_BYTES, LONG, _PIECES, _IDS = 4 << 20, 1 << 18, 1 << 18, 1 << 20
#: Bytes of pieces that every task gets with their ids; of others that a worker keeps; different pieces that a task counts
#: before it hands them on.
SHARED, VOCABULARY, COUNTED = 8 << 20, 2 << 20, 1 << 17
_TABLES: dict[bytes, Merges] = {}


class Merges:
    """Ranks of tokens, and of all pairs of tokens that join to a token."""

    def __init__(self, lines: bytes):
        pairs = (line.split() for line in lines.splitlines() if line.strip())
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for t, r in self.rank.items():
            self.token[r] = t
        self.size = len(self.token)
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        keys, ranks = [], []
        for t, r in self.rank.items():
            for k in range(1, len(t)):
                a, b = self.rank.get(t[:k]), self.rank.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    ranks.append(r)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.int64(2**62))
        self.ranks = np.append(np.array(ranks, np.int32)[order], _NONE)
        self.lengths = np.array([len(t) for t in self.token], np.int64)
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, want)
        return np.where(self.keys[at] == want, self.ranks[at], _NONE)

    def alone(self, piece: bytes) -> list[int]:
        """One piece, the leftmost of its least pairs at a time, from a heap of (rank, place)."""
        n = len(piece)
        token = self.single[np.frombuffer(piece, np.uint8)].tolist()
        after, before, size = [*range(1, n), -1], [*range(-1, n - 1)], [1] * n

        def rank(i: int) -> int | None:
            j = after[i]
            return None if j < 0 else self.rank.get(piece[i : j + size[j]])

        waiting = [(r, i) for i in range(n) if (r := rank(i)) is not None]
        heapify(waiting)
        while waiting:
            r, i = heappop(waiting)
            if token[i] < 0 or rank(i) != r:
                continue
            j = after[i]
            token[i], token[j], size[i], after[i] = r, -1, size[i] + size[j], after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heappush(waiting, (r, k))
        return [t for t in token if t >= 0]

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces, end to end, and how many each piece has."""
        whole = np.array([self.rank.get(p, -1) for p in pieces], np.int32)
        rest = np.flatnonzero(whole < 0)
        ids, counts = self._merge([pieces[i] for i in rest])
        count = np.ones(len(pieces), np.int64)
        count[rest] = counts
        begin = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        out[begin[whole >= 0]] = whole[whole >= 0]
        own = np.ones(len(out), bool)
        own[begin[whole >= 0]] = False
        out[own] = ids
        return out, count

    def _merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n = len(flat)
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), size)
        token = self.single[flat]
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        stop = np.cumsum(size)
        after[stop[size > 0] - 1] = -1
        before[(stop - size)[size > 0]] = -1
        rank = np.full(n, _NONE, np.int32)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self._bytes()[flat[inner].astype(np.int64) * 256 + flat[inner + 1]]
        index: dict[int, list[np.ndarray]] = {}

        def add(places, ranks):
            """Enter places under their ranks."""
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            first = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]])
            ends = np.r_[first[1:], len(ranks)].tolist()
            for r, a, b in zip(ranks[first].tolist(), first.tolist(), ends, strict=True):
                if r in index:
                    index[r].append(places[a:b])
                else:
                    index[r] = [places[a:b]]
                    heappush(waiting, r)

        waiting: list[int] = []
        found = inner[rank[inner] < _NONE].astype(np.int32)
        if len(found):
            add(found, rank[found])
        heapify(waiting)
        unsure: set[int] = set()
        while waiting:
            r = heappop(waiting)
            at = np.unique(np.concatenate(index.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                touch = np.r_[False, after[at[:-1]] == at[1:]]
                if touch.any():  # of places that overlap in a row, every second goes
                    place = np.arange(len(at))
                    at = at[(place - np.maximum.accumulate(np.where(touch, 0, place))) % 2 == 0]
            gone = after[at]
            follow = after[gone]
            token[at], token[gone], rank[gone] = r, -1, _NONE
            after[at] = follow
            before[follow[follow >= 0]] = at[follow >= 0]
            left = before[at]
            spots = np.concatenate([at, left[left >= 0]])
            right = after[spots]
            fresh = np.full(len(spots), _NONE, np.int32)
            fresh[right >= 0] = self.of_pairs(token[spots[right >= 0]], token[right[right >= 0]])
            rank[spots] = fresh
            some = fresh < _NONE
            if some.any():
                add(spots[some], fresh[some])
                if (fresh < r).any():
                    owners, times = np.unique(piece[at], return_counts=True)
                    unsure.update(np.intersect1d(owners[times > 1], piece[spots[fresh < r]]).tolist())
        live = token >= 0
        count = np.bincount(piece[live], minlength=len(pieces))
        ids = token[live]
        if unsure:
            parts = np.split(ids, np.cumsum(count)[:-1])
            for i in unsure:
                parts[i] = np.array(self.alone(pieces[i]), np.int32)
            ids, count = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, count

    def _bytes(self) -> np.ndarray:
        """Rank of each pair of bytes."""
        if not hasattr(self, "_pairs"):
            left, right = np.repeat(self.single, 256), np.tile(self.single, 256)
            self._pairs = self.of_pairs(left, right)
        return self._pairs

    def decode(self, ids: np.ndarray) -> bytes:
        return ragged(self.bytes, self.starts[ids], self.lengths[ids]).tobytes()


def merges(lines: bytes) -> Merges:
    """The table of a rank file, made once in a process."""
    key = hashlib.sha1(lines).digest()
    if key not in _TABLES:
        _TABLES[key] = Merges(lines)
        _TABLES[key].key = key
    return _TABLES[key]


def read_ranks(path: str) -> bytes:
    """A rank file's bytes: a token in base64 and its rank on a line."""
    with open(path, "rb") as file:
        return file.read()


def parts_of(match, text: str) -> Iterator[list[str]]:
    """The pieces of a text, a bounded count at a time."""
    if len(text) < LONG:
        yield match.findall(text)
        return
    pieces = match.finditer(text)
    while part := [m[0] for m in islice(pieces, _PIECES)]:
        yield part


class Vocabulary:
    """Pieces by number with their ids: those of the corpus, and after them the ones met here and not among those."""

    def __init__(self, table: Merges, pieces: list[str], ids: np.ndarray, count: np.ndarray):
        self.table, self.shared = table, len(pieces)
        self.number: dict[str, int] = defaultdict(None, zip(pieces, range(len(pieces)), strict=True))
        self.number.default_factory = self.number.__len__
        self.ids, self.count, self.size = ids, count, 0
        self.begin = np.cumsum(count) - count

    def clear(self) -> None:
        """Forget what the corpus does not share."""
        for piece in list(islice(self.number, self.shared, None)):
            del self.number[piece]
        self.begin, self.count, self.size = self.begin[: self.shared], self.count[: self.shared], 0
        self.ids = self.ids[: int(self.count.sum())]

    def codes(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, pieces), np.int32, len(pieces))

    def learn(self) -> None:
        """Replay the pieces that have a number but no ids yet."""
        fresh = [p.encode() for p in islice(self.number, len(self.count), None)]
        if fresh:
            ids, count = self.table.replay(fresh)
            self.begin = np.r_[self.begin, len(self.ids) + np.cumsum(count) - count]
            self.count, self.ids, self.size = np.r_[self.count, count], np.r_[self.ids, ids], self.size + sum(map(len, fresh))

    def of(self, codes: np.ndarray) -> np.ndarray:
        return ragged(self.ids, self.begin[codes], self.count[codes])

    def encode(self, match, texts: Iterable[str | None]) -> list[np.ndarray]:
        """The ids of each text.  What is not shared is learnt for all short texts at once, and for a long one in parts."""
        out: list[np.ndarray] = []
        held: list[tuple[int, np.ndarray]] = []

        def settle() -> None:
            self.learn()
            if held:
                codes = np.concatenate([c for _, c in held])
                ids, ends = self.of(codes), np.r_[0, np.cumsum(self.count[codes])][np.cumsum([len(c) for _, c in held])]
                for (i, _), a, b in zip(held, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    out[i] = ids[a:b]
                held.clear()
            if self.size > VOCABULARY:
                self.clear()

        for i, text in enumerate(texts):
            out.append(np.zeros(0, np.int32))
            if text and len(text) < LONG:
                held.append((i, self.codes(match.findall(text))))
            elif text:
                settle()
                parts = []
                for pieces in parts_of(match, text):
                    codes = self.codes(pieces)
                    self.learn()
                    parts.append(self.of(codes))
                    if self.size > VOCABULARY:
                        self.clear()
                out[i] = np.concatenate(parts) if parts else out[i]
        settle()
        return out


#: The vocabulary of the encoding that this worker is at.
_VOCABULARY: dict[str, Vocabulary] = {}


def replayed(texts: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """piece, n, ids: the distinct pieces of all texts (column text), in how many chunks of texts they stand, and their token ids.

    A written table; each piece is in one row and was replayed once, together with the others of its part.
    """
    held = texts.sparkSession.sparkContext.broadcast(ranks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _VOCABULARY.clear()  # that of an encoding before this one
        match, seen = regex.compile(pattern), Counter()
        row = lambda: pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["piece", "n"])
        for chunk in chunks(batches, CHUNK_BYTES):
            here: set[str] = set()
            for text in chunk.column("text"):
                for pieces in parts_of(match, text.as_py()) if text.is_valid else ():
                    here.update(pieces)
                    if len(here) > COUNTED:
                        seen.update(here)
                        here.clear()
                        yield row()
                        seen.clear()
            seen.update(here)
            if len(seen) > COUNTED:
                yield row()
                seen.clear()
        yield row()

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merges(held.value)
        for chunk in chunks(batches, CHUNK_BYTES, "piece"):
            chunk = chunk.combine_chunks()
            ids, count = table.replay([p.encode() for p in chunk.column("piece").to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.array(ids))
            yield from chunk.append_column("ids", lists).to_batches()

    counted = texts.select("text").mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return durable(counted.mapInArrow(replay, "piece string, n long, ids array<int>"))


def most_frequent(vocabulary: DataFrame, bound: int) -> pa.Table:
    """piece and ids of the most frequent pieces, all that stand in at least 2 ** k chunks, for the least k that stays in the bound."""
    level = F.floor(F.log2(F.col("n").cast("double")) + 1e-9)
    sizes = {r.k: r.b for r in vocabulary.groupBy(level.alias("k")).agg(F.sum(F.octet_length("piece") + 4 * F.size("ids")).alias("b")).collect()}  # 63 rows at most
    least, total = 63, 0
    for k in range(62, -1, -1):
        total += sizes.get(k, 0)
        if total > bound:
            break
        least = k
    return vocabulary.filter(level >= least).select("piece", "ids").toArrow()


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """id_col, ids: the token ids of each row's whole text (null and empty text: no ids), without special tokens.

    pattern splits the text; each match is encoded on its own.  One row for each input row, repeats and null ids too.
    With `decoded` a third column has the bytes that the ids stand for, as decode() gives them, from the same pass.
    """
    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), F.col("text").cast("string"))
    context, key = docs.sparkSession.sparkContext, uuid.uuid4().hex
    found = most_frequent(replayed(rows, ranks, pattern), SHARED).combine_chunks()
    lists = pa.concat_arrays(found.column("ids").chunks) if found.num_rows else pa.array([], pa.list_(pa.int32()))
    shared = context.broadcast((found.column("piece").to_pylist(), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.diff(lists.offsets.to_numpy()).astype(np.int64) if len(lists) else np.zeros(0, np.int64)))
    held = context.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, match = merges(held.value), regex.compile(pattern)
        if key not in _VOCABULARY:
            _VOCABULARY.clear()
            _VOCABULARY[key] = Vocabulary(table, *shared.value)
        for chunk in chunks(batches, CHUNK_BYTES):
            ids = _VOCABULARY[key].encode(match, (t.as_py() for t in chunk.column("text")))
            keys = chunk.column("id").combine_chunks()
            size = np.cumsum([len(x) for x in ids])
            a = 0
            while a < len(ids):
                b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + _IDS, "right")))
                ends = np.r_[0, size[a:b] - (size[a - 1] if a else 0)]
                columns = [keys.slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids[a:b])))]
                if decoded:
                    columns.append(pa.array([table.decode(x) for x in ids[a:b]], pa.binary()))
                yield pa.record_batch(columns, names=names)
                a = b

    names = ["id", "ids", "decoded"][: 2 + decoded]
    return rows.mapInArrow(run, "id long, ids array<int>" + ", decoded binary" * decoded).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, ids, decoded: the bytes that each row's ids stand for.  Null ids decode to no bytes."""
    held = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        table = merges(held.value)
        for batch in batches:
            out = [table.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid and len(x.values) else b"" for x in batch.column("ids")]
            yield pa.record_batch([batch.column("id"), batch.column("ids"), pa.array(out, pa.binary())], names=["id", "ids", "decoded"])

    rows = pick(encoded, id=id_col, ids=ids_col).select(F.col("id").cast("long"), F.col("ids").cast("array<int>"))
    return rows.mapInArrow(run, "id long, ids array<int>, decoded binary").withColumnRenamed("id", id_col)
