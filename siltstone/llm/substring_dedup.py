"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark, merged into maximal removal intervals.

One map pass hashes each window of `window` words (64-bit rolling polynomial over word hashes).  Within a chunk of
rows only the smallest document of each hash goes on; the others are known to lose that window at once, so a passage
that a third of all rows share costs one entry a chunk, not one a row.  Entries are dealt by hash to buckets, whose
number follows the input's bytes; a bucket finds for each hash the smallest document over all chunks and returns the
positions where larger ones start, packed by slots of rows, so that what travels back has as many rows as there are
pairs of bucket and slot.  A slot's positions are put together by row, meet the texts, overlap into intervals, and the
words go.

An entry keeps the low 56 bits of its hash, and its bucket is the whole hash modulo an odd number, so both together tell
hashes apart by 56 bits and the logarithm of the number of buckets: by 61.7 bits with 53 buckets, where n windows have
about n*n/2**62.7 chance pairs, 0.003 for 140 million windows; by all 64 bits from 257 buckets on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import chunks, parts_for, pick, ragged, utf8, word_hashes, word_spans

_RADIX = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text to a bucket; its entries take about 1.6 times as much.
BUCKET_BYTES = 16 << 20
#: Bytes of text hashed together; arrays of a chunk take about 16 times as much.
CHUNK_BYTES = 8 << 20

_ENTRY = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("runs", pa.binary()), ("hashes", pa.binary()), ("spots", pa.binary())])
_HIT = pa.schema([("slot", pa.int32()), ("ids", pa.binary()), ("runs", pa.binary()), ("spots", pa.binary())])
_ROW = pa.schema([("id", pa.int64()), ("sig", pa.int64()), ("hits", pa.binary())])
_CLEAN = pa.schema([("id", pa.int64()), ("clean_text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64())))])


def window_hashes(words: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window within a row: rolling hash, row, place of its first word in the row."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    roll = np.zeros(n, np.uint64)
    for k in range(window):
        roll *= _RADIX
        roll += words[k : k + n]
    count = np.maximum(np.diff(bounds) - window + 1, 0)
    row = np.repeat(np.arange(len(count), dtype=np.int32), count)
    spot = np.arange(len(row), dtype=np.int32) - np.repeat((np.cumsum(count) - count).astype(np.int32), count)
    return roll[bounds[:-1][row] + spot], row, spot


def _runs(order_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.r_[True, order_keys[1:] != order_keys[:-1]]) if len(order_keys) else np.zeros(0, np.int64)


def _spread(x: np.ndarray, parts: int) -> np.ndarray:
    return ((x * _SPREAD) >> np.uint64(33)).astype(np.int64) % parts


def _slots(ids: np.ndarray, rows: np.ndarray, spots: np.ndarray, slots: int):
    """Pack (row, spot) pairs by slots of their rows: slot, ids of its rows, how many spots each has, the spots."""
    order = np.lexsort((spots, rows))
    rows, spots = rows[order], spots[order].astype("<u4")
    begin = _runs(rows)
    count = np.diff(np.r_[begin, len(rows)])
    own = ids[rows[begin]]
    slot = _spread(own[:, 0].astype(np.uint64) ^ own[:, 1].astype(np.uint64), slots)
    for one in np.unique(slot).tolist():
        some = np.flatnonzero(slot == one)
        yield one, own[some].astype("<i8").tobytes(), count[some].astype("<u4").tobytes(), ragged(spots, begin[some], count[some]).tobytes()


def _mapper(window: int, buckets: int):
    def run(batches):
        for table in chunks(batches, CHUNK_BYTES):
            ids, sig = (table.column(c).to_numpy() for c in ("id", "sig"))
            keys = np.column_stack([ids, sig])
            data, offsets = utf8(table.column("text"))
            start, end, bounds = word_spans(data, offsets)
            roll, row, spot = window_hashes(word_hashes(data, start, end), bounds, window)
            if not len(roll):
                continue
            order = np.argsort(roll)
            begin = _runs(roll[order])
            least = np.minimum.reduceat(ids[row[order]], begin)
            owner = np.empty(len(roll), np.int64)
            owner[order] = np.repeat(least, np.diff(np.r_[begin, len(roll)]))
            lost = ids[row] > owner
            if lost.any():
                some = [*_slots(keys, row[lost], spot[lost], buckets)]
                slot, own, runs, spots = zip(*some, strict=True)
                yield pa.record_batch([pa.array(slot, pa.int32()), pa.array(own, pa.binary()), pa.array(runs, pa.binary()), pa.nulls(len(some), pa.binary()), pa.array(spots, pa.binary())], schema=_ENTRY)
            roll, row, spot = roll[~lost], row[~lost], spot[~lost]
            roll = roll * _SPREAD
            bucket = (roll % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            roll, row, spot, bucket = roll[order], row[order], spot[order], bucket[order]
            begin = _runs(bucket)
            out = {name: [] for name in _ENTRY.names}
            for a, b in zip(begin, np.r_[begin[1:], len(bucket)], strict=True):
                first = _runs(row[a:b])
                which = row[a:b][first]
                out["bucket"].append(int(bucket[a]))
                out["ids"].append(keys[which].astype("<i8").tobytes())
                out["runs"].append(np.diff(np.r_[first, b - a]).astype("<u4").tobytes())
                out["hashes"].append(roll[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes())
                step = np.diff(spot[a:b], prepend=0)
                step[first] = spot[a:b][first]
                out["spots"].append(step.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())
            yield pa.record_batch([pa.array(out[n], _ENTRY.field(n).type) for n in _ENTRY.names], schema=_ENTRY)

    return run


def _reducer(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        found = table.filter(pc.is_null(table.column("hashes"))).select(["bucket", "ids", "runs", "spots"]).rename_columns(_HIT.names)
        keys, rolls, docs, spots, n = [], [], [], [], 0
        for packed, runs, hashes, places in zip(*(table.column(c) for c in ("ids", "runs", "hashes", "spots")), strict=True):
            if not hashes.is_valid:
                continue
            key = np.frombuffer(packed.as_buffer(), "<i8").reshape(-1, 2)
            run = np.frombuffer(runs.as_buffer(), "<u4").astype(np.int64)
            step = np.frombuffer(places.as_buffer(), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
            head = np.cumsum(run) - run
            total = np.cumsum(step, dtype=np.int64)
            spots.append((total - np.repeat(total[head] - step[head], run)).astype(np.int32))
            docs.append(np.repeat(np.arange(n, n + len(key), dtype=np.int32), run))
            roll = np.zeros((len(step), 8), np.uint8)
            roll[:, :7] = np.frombuffer(hashes.as_buffer(), np.uint8).reshape(-1, 7)
            rolls.append(roll.view("<u8").ravel())
            keys.append(key)
            n += len(key)
        if not keys:
            return found.cast(_HIT)
        key, roll, doc, spot = (np.concatenate(x) for x in (keys, rolls, docs, spots))
        del keys, rolls, docs, spots
        order = np.argsort(roll)
        begin = _runs(roll[order])
        size = np.diff(np.r_[begin, len(roll)])
        order, size = order[np.repeat(size > 1, size)], size[size > 1]
        if len(order):
            ids = key[doc[order], 0]
            order = order[ids > np.repeat(np.minimum.reduceat(ids, np.cumsum(size) - size), size)]
        if not len(order):
            return found.cast(_HIT)
        slot, own, runs, places = zip(*_slots(key, doc[order], spot[order], buckets), strict=True)
        more = pa.table([pa.array(slot, pa.int32()), pa.array(own, pa.binary()), pa.array(runs, pa.binary()), pa.array(places, pa.binary())], schema=_HIT)
        return pa.concat_tables([found.cast(_HIT), more])

    return run


def _gather(table: pa.Table) -> pa.Table:
    """All spots of each row of a slot."""
    own, runs, spots = (b"".join(table.column(c).to_pylist()) for c in ("ids", "runs", "spots"))
    key, run, spot = np.frombuffer(own, "<i8").reshape(-1, 2), np.frombuffer(runs, "<u4").astype(np.int64), np.frombuffer(spots, "<u4")
    pairs, which = np.unique(key, axis=0, return_inverse=True)
    row = np.repeat(which.ravel(), run)
    order = np.argsort(row, kind="stable")
    begin = np.searchsorted(row[order], np.arange(len(pairs) + 1))
    spot = spot[order]
    hits = [spot[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
    return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(hits, pa.binary())], schema=_ROW)


def _remover(window: int):
    def run(batches):
        for table in chunks(batches, 8 << 20):
            out = {name: [] for name in _CLEAN.names}
            for key, text, hits in zip(*(table.column(c) for c in ("id", "text", "hits")), strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                kept, spans, gone = words, [], 0
                if hits.is_valid:
                    spots = np.frombuffer(hits.as_buffer(), "<u4").astype(np.int64)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, spots, 1)
                    np.add.at(edge, spots + window, -1)
                    lost = np.cumsum(edge[:-1]) > 0
                    turn = np.flatnonzero(np.diff(np.r_[False, lost, False]))
                    spans, gone = turn.reshape(-1, 2).tolist(), int(lost.sum())
                    kept = [w for w, x in zip(words, lost.tolist(), strict=True) if not x]
                for name, value in zip(_CLEAN.names, (key.as_py(), b" ".join(kept), len(words), gone, spans), strict=True):
                    out[name].append(value)
            out["clean_text"] = pa.array(out["clean_text"], pa.binary()).cast(pa.string())
            yield pa.record_batch([x if isinstance(x := out[n], pa.Array) else pa.array(x, _CLEAN.field(n).type) for n in _CLEAN.names], schema=_CLEAN)

    return run


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """Remove every word that a window of `window` words covers which also starts in a row with a smaller id.

    Returns id_col, clean_text (kept words joined by a space), n_words, n_removed, spans (maximal intervals of removed
    words as [begin, end)).  A null text has no words; a null id neither owns nor loses windows; rows that repeat an id
    do not count as smaller to each other; an empty table gives an empty result.  Whole texts, all windows.
    """
    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("sig", F.xxhash64("text"))
    buckets = parts_for(rows, F.octet_length("text"), BUCKET_BYTES) | 1
    entries = rows.filter("id is not null and text is not null").mapInArrow(_mapper(window, buckets), "bucket int, ids binary, runs binary, hashes binary, spots binary")
    hits = (
        entries.repartitionById(buckets, "bucket")
        .groupBy("bucket")
        .applyInArrow(_reducer(buckets), "slot int, ids binary, runs binary, spots binary")
        .repartitionById(buckets, "slot")
        .groupBy("slot")
        .applyInArrow(_gather, "id long, sig long, hits binary")
    )
    joined = rows.join(hits, ["id", "sig"], "left").select("id", "text", "hits")
    return joined.mapInArrow(_remover(window), "id long, clean_text string, n_words long, n_removed long, spans array<array<long>>").withColumnRenamed("id", id_col)
