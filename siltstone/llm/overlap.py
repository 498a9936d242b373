"""All pairs of similar sets of shingles, by prefixes of their rarest members and parity maps: no similar pair is left out.

Shingles have one order, rare ones first.  Sets whose Jaccard similarity is at least t share one of their first members, of
which a set of n has n - ceil(t * n) + 1, so sets meet by these alone.  How rare a shingle is comes from counts of hash
buckets over all texts; the order only decides how many sets meet, never which similar ones are found.

A parity map has a bit for each hash residue, set if an odd number of a set's members has it.  Two maps differ in no more
bits than their sets differ in members, so where they differ in more than similar sets can, the pair is none.  A map has
two to four bits a member; a longer one folds to the length of a shorter.

Sets that share a member with few others meet as pairs; a member of many sets has its sets grouped, in parts if there are
very many, and returns stars.  Nodes are hashes of sets, so equal sets are one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import chunks, durable, parts_for, pick

#: Bits of the hash buckets in which shingles are counted; buckets in a row of counts; bytes of text hashed at a time.
BUCKET_BITS, PIECE, CHUNK_BYTES = 18, 1 << 12, 8 << 20
#: Sets of one member that meet as pairs at most; sets that one task compares at most; bytes of members, or of maps, to a task.
FEW, PART, TASK_BYTES = 16, 8192, 12 << 20
#: Shingles hashed at a time.
_BLOCK = 1 << 16
_MASK = np.uint64((1 << BUCKET_BITS) - 1)
_MEMBER = np.dtype([("token", "<u8"), ("node", "<i8"), ("size", "<u4")])
_MET = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("token", pa.int64())])
_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_SETS = pa.schema([("id", pa.int64()), ("sig", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("map", pa.binary()), ("piece", pa.int32()), ("counts", pa.binary())])


def shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """The 64-bit hash of each run of `words` words in lower case; a shorter text is one shingle, one without words none."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    stop = np.cumsum(size + 1) - 1
    start = stop - size
    if len(tokens) > words:
        start, stop = start[: len(tokens) - words + 1], stop[words - 1 :]
    else:
        start, stop = start[:1], stop[-1:]
    out = np.empty(len(start), np.uint64)
    for a in range(0, len(start), _BLOCK):
        spans = zip(start[a : a + _BLOCK].tolist(), stop[a : a + _BLOCK].tolist(), strict=True)
        out[a : a + _BLOCK] = np.frombuffer(b"".join([xxhash.xxh64_digest(joined[b:e], seed) for b, e in spans]), ">u8")
    return out


def shingle_set(text: pa.Scalar, words: int, seed: int) -> np.ndarray:
    return np.unique(shingle_hashes(text.as_buffer().to_pybytes() if text.is_valid else b"", words, seed))


def node_of(members: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh64_digest(members.tobytes()), "big", signed=True)


def parity(members: np.ndarray) -> bytes:
    """The parity map of a set: a power of two of bits, two to four for each member and 64 at least."""
    bits = max(64, 2 << max(len(members) - 1, 0).bit_length())
    odd = np.bincount((members >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def prefix(members: np.ndarray, rank: np.ndarray, least: float) -> np.ndarray:
    """The first members of a set in the order of their buckets, as tokens: a bijection of hashes that keeps the order."""
    some = len(members) - math.ceil(least * len(members) - 1e-9) + 1
    tokens = rank[members & _MASK] << np.uint64(64 - BUCKET_BITS) | members >> np.uint64(BUCKET_BITS)
    return np.partition(tokens, some - 1)[:some] if some < len(tokens) else tokens


def _most(a, b, least: float):
    """Members in which similar sets of these sizes can differ."""
    return np.floor((1 - least) / (1 + least) * (a + b) + 1e-6)


class Maps:
    """Parity maps of sets, by length; near() tells which sets may be similar to one."""

    def __init__(self, size: np.ndarray, maps: list[bytes], least: float) -> None:
        self.size, self.least = size, least
        self.wide = np.fromiter(map(len, maps), np.int64, len(maps))
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for wide in np.unique(self.wide).tolist():
            own, twice = np.flatnonzero(self.wide == wide), np.flatnonzero(self.wide == 2 * wide)
            rows = np.concatenate([_stack(maps, own, wide), _fold(_stack(maps, twice, 2 * wide))])
            at = np.full(len(maps), -1, np.int64)
            at[np.concatenate([own, twice])] = np.arange(len(own) + len(twice))
            self.held[wide] = rows, at

    def near(self, x: int, rest: np.ndarray) -> np.ndarray:
        size, one = self.size[rest], self.size[x]
        rest = rest[np.minimum(size, one) >= self.least * np.maximum(size, one) - 1e-9]
        out = []
        for wide in {int(self.wide[x]), int(self.wide[x]) // 2} & self.held.keys():  # sizes differ by a quarter, so lengths by one step
            rows, at = self.held[wide]
            some = rest[np.minimum(self.wide[rest], self.wide[x]) == wide]
            differ = np.bitwise_count(rows[at[some]] ^ self._row(x, wide)).sum(axis=1, dtype=np.int64)
            out.append(some[differ <= _most(self.size[some], one, self.least)])
        return np.sort(np.concatenate(out))

    def _row(self, x: int, wide: int) -> np.ndarray:
        rows, at = self.held[wide]
        return rows[at[x]]


def _stack(maps: list[bytes], which: np.ndarray, wide: int) -> np.ndarray:
    return np.frombuffer(b"".join([maps[i] for i in which.tolist()]), "<u8").reshape(-1, wide // 8)


def _fold(rows: np.ndarray) -> np.ndarray:
    half = rows.shape[1] // 2
    return rows[:, :half] ^ rows[:, half:]


def reached(n: int, near) -> np.ndarray:
    """A label for each of n: equal for those that chains of near(x, rest) join.

    What is reached is compared only with what is not reached yet, so many that are alike cost little more than their number.
    """
    label, rest = np.empty(n, np.int64), np.arange(n)
    while len(rest):
        seed, rest = rest[0], rest[1:]
        label[seed], front = seed, [seed]
        while front and len(rest):
            found = near(front.pop(), rest)
            if len(found):
                label[found] = seed
                front += found.tolist()
                rest = rest[~np.isin(rest, found)]
    return label


def stars(label: np.ndarray, node: np.ndarray) -> pa.Table:
    """A link from each node to the least of its label."""
    _, place = np.unique(label, return_inverse=True)
    low = np.full(place.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, place, node)
    edge = low[place] != node
    return pa.Table.from_arrays([pa.array(node[edge]), pa.array(low[place][edge])], schema=_EDGES)


def sets(docs: DataFrame, id_col: str, text_col: str, words: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    """id, sig (a hash of the text), node (one of its shingle set), size, map of each row; and the order of the buckets."""

    def run(batches):
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for table in chunks(batches, CHUNK_BYTES):
            found = [shingle_set(t, words, seed) for t in table.column("text")]
            counts += np.bincount((np.concatenate(found) & _MASK).astype(np.int64), minlength=len(counts))
            own = [pa.array([node_of(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([parity(x) for x in found], pa.binary())]
            none = [pa.nulls(len(found), pa.int32()), pa.nulls(len(found), pa.binary())]
            yield pa.record_batch([table.column("id").combine_chunks(), table.column("sig").combine_chunks(), *own, *none], schema=_SETS)
        if counts.any():
            pieces = counts.astype("<u4").reshape(-1, PIECE)
            columns = [pa.nulls(len(pieces), f.type) for f in list(_SETS)[:5]]
            yield pa.record_batch([*columns, pa.array(range(len(pieces)), pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())], schema=_SETS)

    def total(table):
        counts = sum(np.frombuffer(c.as_buffer(), "<u4").astype("<i8") for c in table.column("counts"))
        return pa.table({"piece": table.column("piece")[:1], "counts": pa.array([counts.tobytes()], pa.binary())})

    rows = _rows(docs, id_col, text_col)
    both = durable(rows.mapInArrow(run, "id long, sig long, node long, size long, map binary, piece int, counts binary"))
    pieces = both.filter("piece is not null").select("piece", "counts").groupBy("piece").applyInArrow(total, "piece int, counts binary")
    counts = b"".join(bytes(r["counts"]) for r in sorted(pieces.collect(), key=lambda r: r["piece"]))  # 2 MB for tables of any size
    order = np.argsort(np.frombuffer(counts, "<i8") if counts else np.zeros(1 << BUCKET_BITS, np.int64), kind="stable")
    rank = np.empty(len(order), np.uint64)
    rank[order] = np.arange(len(order), dtype=np.uint64)
    return both.filter("piece is null").drop("piece", "counts"), rank


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = pick(docs, id=id_col, text=text_col)
    return rows.select(F.col("id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("sig"), F.col("text").cast("string"))


def _deal(words: int, seed: int, least: float, rank, parts: int):
    """Map texts to the first members of their sets, packed for each part of the tokens."""

    def run(batches):
        for table in chunks(batches, CHUNK_BYTES):
            held = {}
            for text in table.column("text"):
                members = shingle_set(text, words, seed)
                node = node_of(members)
                if len(members) and node not in held:
                    held[node] = len(members), prefix(members, rank.value, least)
            if not held:
                continue
            many = np.fromiter((len(p) for _, p in held.values()), np.int64, len(held))
            rows = np.empty(many.sum(), _MEMBER)
            rows["token"] = np.concatenate([p for _, p in held.values()])
            rows["node"] = np.repeat(np.fromiter(held, np.int64, len(held)), many)
            rows["size"] = np.repeat(np.fromiter((n for n, _ in held.values()), np.uint32, len(held)), many)
            part = (rows["token"] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            rows, part = rows[order], part[order]
            begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            packed = [rows[a:b].tobytes() for a, b in zip(begin, np.r_[begin[1:], len(rows)], strict=True)]
            yield pa.record_batch([pa.array(part[begin]), pa.array(packed, pa.binary())], names=["part", "members"])

    return run


def _meet(least: float):
    """Pairs u, v of the sets of tokens that few have; u, token of those that many have."""

    def run(table):
        rows = np.concatenate([np.frombuffer(m.as_buffer(), _MEMBER) for m in table.column("members")])
        token, node, size = (np.ascontiguousarray(rows[n]) for n in ("token", "node", "size"))
        order = np.lexsort((node, token))
        token, node, size = token[order], node[order], size[order].astype(np.int64)
        new = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])]
        token, node, size = token[new], node[new], size[new]
        begin = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        count = np.diff(np.r_[begin, len(token)])
        many = np.repeat(count > FEW, count)
        some = np.repeat((count > 1) & (count <= FEW), count)
        big_node, big_token = node[many], token[many].view(np.int64)
        token, node, size = token[some], node[some], size[some]
        pairs = []
        for step in range(1, min(FEW, len(token))):
            a, b = size[:-step], size[step:]
            near = (token[:-step] == token[step:]) & (np.minimum(a, b) >= least * np.maximum(a, b) - 1e-9)
            pairs.append(np.column_stack([node[:-step][near], node[step:][near]]))
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *pairs])
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        pairs = pairs[np.r_[True, (pairs[1:] != pairs[:-1]).any(axis=1)]] if len(pairs) else pairs
        none = lambda n: pa.nulls(n, pa.int64())
        met = [pa.array(np.r_[pairs[:, 0], big_node])]
        met += [pa.concat_arrays([pa.array(pairs[:, 1]), none(len(big_node))]), pa.concat_arrays([none(len(pairs)), pa.array(big_token)])]
        return pa.Table.from_arrays(met, schema=_MET)

    return run


def _compare(least: float):
    """Keep the pairs whose maps let them be similar."""

    def run(batches):
        for batch in batches:
            u, v, a, b = (batch.column(n).to_numpy() for n in ("u", "v", "size", "size_v"))
            x, y = (batch.column(n).to_pylist() for n in ("map", "map_v"))
            wide = np.column_stack([np.fromiter(map(len, m), np.int64, len(u)) for m in (x, y)])
            keep = np.zeros(len(u), bool)
            for p, q in np.unique(wide, axis=0).tolist():
                own = np.flatnonzero((wide[:, 0] == p) & (wide[:, 1] == q))
                left, right = _stack(x, own, p), _stack(y, own, q)
                while left.shape[1] > right.shape[1]:
                    left = _fold(left)
                while right.shape[1] > left.shape[1]:
                    right = _fold(right)
                keep[own] = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64) <= _most(a[own], b[own], least)
            yield pa.record_batch([pa.array(u[keep]), pa.array(v[keep])], schema=_EDGES)

    return run


def _gather(least: float):
    """Stars of the sets of each token whose maps let them be similar."""

    def run(table):
        token, node, size = (table.column(n).to_numpy() for n in ("token", "node", "size"))
        maps, order = table.column("map").to_pylist(), np.argsort(token, kind="stable")
        out = []
        for own in np.split(order, np.flatnonzero(np.diff(token[order])) + 1):
            held = Maps(size[own], [maps[i] for i in own.tolist()], least)
            out.append(stars(reached(len(own), held.near), node[own]))
        return pa.concat_tables(out)

    return run


def candidates(docs: DataFrame, found: DataFrame, rank: np.ndarray, id_col: str, text_col: str, words: int, seed: int, least: float) -> DataFrame:
    """Links u, v of nodes: chains of them join all sets of similarity `least` or more, and few others."""
    if least < 0.5:  # the maps of similar sets are of one length or of the next
        raise ValueError("the least similarity is 0.5 or more")
    spark = docs.sparkSession
    parts = parts_for(found, F.col("size") * (1 - least) * _MEMBER.itemsize + 2 * _MEMBER.itemsize, TASK_BYTES)
    packed = _rows(docs, id_col, text_col).select("text").mapInArrow(_deal(words, seed, least, spark.sparkContext.broadcast(rank), parts), "part long, members binary")
    met = durable(packed.groupBy("part").applyInArrow(_meet(least), "u long, v long, token long"))
    nodes = durable(found.groupBy("node").agg(F.first("size").alias("size"), F.first("map").alias("map")))
    pairs = met.filter("v is not null").select("u", "v").distinct()
    pairs = pairs.join(nodes.withColumnRenamed("node", "u"), "u").join(nodes.select(F.col("node").alias("v"), F.col("size").alias("size_v"), F.col("map").alias("map_v")), "v")
    near = pairs.select("u", "v", "size", "size_v", "map", "map_v").mapInArrow(_compare(least), "u long, v long")
    many = met.filter("v is null").select("token", F.col("u").alias("node")).join(nodes, "node")
    slots = parts_for(many, F.length("map") + 24, TASK_BYTES)
    sizes = met.filter("v is null").groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PART)
    sizes = sizes.select("token", F.ceil(F.col("n") / (PART / 2)).cast("long").alias("parts"))
    dealt = many.join(sizes, "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    dealt = dealt.withColumn("slot", F.when(F.col("parts") > 1, F.col("token")).otherwise(F.pmod(F.xxhash64("token"), F.lit(slots))))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("slot", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "token", "node", "size", "map")
    return near.unionByName(dealt.groupBy("slot", "i", "j").applyInArrow(_gather(least), "u long, v long"))
