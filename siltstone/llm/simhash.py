"""SimHash near-dedup: segment-popcount embedding, grid range-join under Manhattan distance, exact check.

A fingerprint maps to the bit counts of segments of its bits.  The Manhattan distance of two such vectors is at most
the Hamming distance of the fingerprints, so it serves as a lower bound.  A grid takes some segments and a radius: a
fingerprint lies in one cell and looks into the cells within the radius, and the members of a cell are then compared
bit by bit.  Each cell returns a star for each of its components, at most a link a member.

Narrow thresholds: the 32 segments of two bits fall into grids with radii whose sum plus number exceeds the threshold,
so two fingerprints within it are within the radius in one grid at least.  Every choice of grids finds all pairs.  In a cell of more than ALL
members, two within the threshold are equal in one of as many blocks of bits and one more, so only members that are equal in
a block are compared; a block that more than RUN members share has them compared in tiles.

Wide thresholds, at which texts of a similarity of 0.8 differ in 39 of 256 bits, leave no such grid that prunes.  There
each grid draws its segments, of one bit, from all bits; grids are as fine as keeps about CELL members in a cell, and so
many that a pair which differs in DIFFER of its bits shares a cell with a probability of SURE.  Their number grows with
the 0.27th power of the number of fingerprints, work and shuffle with the 1.27th.

Equal fingerprints are one node, so copies never multiply pairs.  A cell with more than PART members is dealt out as
pairs of parts.  In a cell, the members near a few pivots become stars first, and stars are not compared within.

first_of_similar takes no fingerprints, which would leave out similar pairs: siltstone.llm.overlap finds the groups in
which to look, and links are the pairs of texts in a group whose shingle sets have the similarity asked for.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import chunks, durable, mix, pick, ragged, same
from siltstone.llm.graph import components
from siltstone.llm.overlap import Maps, candidates, parity, reached, sets, shingle_hashes, shingle_set, stars

#: Members of a cell that one task compares with each other at most; bytes of text fingerprinted at a time.
PART, CHUNK_BYTES = 131072, 8 << 20
#: Members of a cell that are compared all with all; members equal in a block of bits that are; fingerprints dealt to cells at a time.
ALL, RUN, EMBED = 256, 512, 1 << 17
#: Texts, and bytes of text, whose shingle sets one task compares with each other at most.
GROUP, GROUP_BYTES = 8192, 24 << 20
#: Wide thresholds: members of a cell aimed at; the share of differing bits for which a shared cell is SURE.
CELL, DIFFER, SURE = 1024, 0.17, 0.99
#: Parts that the texts of a group are dealt to where they meet a list of groups.
SALTS = 16
#: Pivots tried in a cell, and members that make a star.
_PIVOTS, _STAR = 16, 64
#: Shingles hashed at a time.
_BLOCK = 1 << 16
_SEGMENTS = np.arange(64).reshape(32, 2)
_PACKED = pa.schema([("cell", pa.int64()), ("n", pa.int64()), ("members", pa.binary())])
_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def fingerprint(text: bytes, words: int, seed: int, prints: int = 1, distinct: bool = False) -> bytes:
    """`prints` times eight bytes, the most significant first; from the second on the hashes are mixed anew.

    With `distinct` a shingle that a text repeats counts once.
    """
    hashes = shingle_hashes(text, words, seed)
    if distinct:
        hashes = np.unique(hashes)
    if not len(hashes):
        return bytes(8 * prints)
    ones = np.zeros((prints, 64), np.int64)
    for a in range(0, len(hashes), _BLOCK):
        block = hashes[a : a + _BLOCK]
        for k in range(prints):
            own = (block if k == 0 else mix(block + np.uint64(k))).astype(">u8")
            ones[k] += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42, prints: int = 1, distinct: bool = False) -> DataFrame:
    """id, sig, fp: the SimHash bytes of each row's whole text, and a hash of its text.

    A null text is as an empty one: zeros.  A null id stays null.
    """

    def run(batches):
        for table in chunks(batches, CHUNK_BYTES):
            found = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words, seed, prints, distinct) for t in table.column("text")]
            yield pa.record_batch([table.column("id").combine_chunks(), table.column("sig").combine_chunks(), pa.array(found, pa.binary())], names=["id", "sig", "fp"])

    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("sig"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "id long, sig long, fp binary")


def _plan(n: float, bits: int) -> list[tuple[np.ndarray, int]] | None:
    """Grids (bits of each segment, radius) that find all pairs within `bits` of 64: the cheapest for n fingerprints.

    None where the threshold is too wide for these grids.
    """

    def grids(radii):
        return [(own, r) for own, r in zip(np.array_split(_SEGMENTS, len(radii)), radii, strict=True)]

    def cost(choice):
        looks = [sum(_ways(len(s), d) for d in range(r + 1)) for s, r in choice]
        pair = 1 if not len(choice[0][0]) else 0.01  # in cells by blocks, so what counts is that large cells are dealt out
        return sum(400 * n * x + n * n * x * pair * 0.375 ** len(s) for x, (s, _) in zip(looks, choice, strict=True))

    if bits > 8:
        return None
    choices = [[(_SEGMENTS[:0], 0)], grids([0] * (bits + 1))]
    choices += [grids([1] * (bits // 2) + [0] * (bits % 2 + 1))] if bits > 1 else []
    choices += [grids([2, 1])] if bits <= 4 else []
    return min((c for c in choices if sum(r + 1 for _, r in c) > bits or not len(c[0][0])), key=cost)


def wide_plan(n: float, prints: int, seed: int = 5) -> list[tuple[np.ndarray, int]]:
    """Grids of one-bit segments drawn from all bits; a single cell for all where n is at most CELL."""
    fine = min(max(0, math.ceil(math.log2(max(n, 1) / CELL))), 32 * prints)
    many = math.ceil(math.log(1 - SURE) / math.log1p(-((1 - DIFFER) ** fine))) if fine else 1
    rng = np.random.default_rng(seed)
    return [(rng.permutation(64 * prints)[:fine, None], 0) for _ in range(many)]


def _ways(dims: int, distance: int) -> int:
    """About how many grid cells lie at a Manhattan distance."""
    return 1 if distance == 0 else 2 * dims if distance == 1 else 2 * dims * dims


def _shifts(dims: int, radius: int) -> np.ndarray:
    """Steps of Manhattan length up to radius."""
    found = {(0,) * dims}
    for _ in range(radius):
        found |= {x[:i] + (x[i] + s,) + x[i + 1 :] for x, i, s in product(found, range(dims), (-1, 1))}
    return np.array(sorted(found, key=lambda x: sum(map(abs, x))), np.int64).reshape(len(found), dims)


def _counts(bits: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Bit counts of each segment, a row for each fingerprint."""
    return bits[:, segments].sum(axis=2, dtype=np.int64)


def _embed(plan, prints: int):
    """Map fingerprints with their node to packed members of cells; a member is (prints, node)."""

    def joined(batches):
        held, size = [], 0
        for batch in batches:
            held, size = [*held, batch], size + len(batch)
            if size >= EMBED:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches):
        for batch in joined(batches):
            raw = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(-1, 8 * prints)
            bits = np.unpackbits(raw, axis=1)
            member = np.column_stack([raw.view(">i8").astype("<i8"), batch.column("node").to_numpy()])
            for g, (segments, radius) in enumerate(plan):
                wide = segments.shape[1]
                counts, base = _counts(bits, segments), (wide + 1) ** np.arange(len(segments), dtype=np.int64)
                for shift in _shifts(len(segments), radius):
                    at = counts + shift
                    inside = np.flatnonzero(((at >= 0) & (at <= wide)).all(axis=1))
                    cell = (at[inside] @ base) * len(plan) + g
                    order = np.argsort(cell, kind="stable")
                    cell, own = cell[order], member[inside[order]]
                    begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
                    end = np.r_[begin[1:], len(cell)]
                    packed = [own[x:y].tobytes() for x, y in zip(begin, end, strict=True)]
                    yield pa.record_batch([pa.array(cell[begin]), pa.array(end - begin), pa.array(packed, pa.binary())], schema=_PACKED)

    return run


def _deal(prints: int):
    """Deal the members of cells in `parts` parts out to the pairs of parts."""
    names = ["cell", "i", "j", "part", "members"]

    def run(batches):
        for batch in batches:
            for cell, packed, parts in zip(*(batch.column(c) for c in ("cell", "members", "parts")), strict=True):
                member, p = np.frombuffer(packed.as_buffer(), "<i8").reshape(-1, prints + 1), parts.as_py()
                own = (member[:, prints].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % p
                rows = [(min(a, b), max(a, b), a, some) for a in np.unique(own).tolist() for some in [member[own == a].tobytes()] for b in range(p)]
                i, j, part, held = zip(*rows, strict=True)
                columns = [pa.array(x, pa.int64()) for x in ([cell.as_py()] * len(rows), i, j, part)]
                yield pa.record_batch([*columns, pa.array(held, pa.binary())], names=names)

    return run


def _near(fps: np.ndarray, i, j, bits: int, total: int | None) -> np.ndarray:
    """Whether rows i and j of fingerprints are within `bits` in the first print and, if given, `total` in all."""
    near = np.bitwise_count(fps[i, 0] ^ fps[j, 0]) <= bits
    return near if total is None else near & (np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1) <= total)


def _stars(fps: np.ndarray, bits: int, total: int | None) -> np.ndarray:
    """A label for each row: those near one of a few pivots have its label, the others their own."""
    label, rest = np.arange(len(fps)), np.arange(len(fps))
    for k in range(_PIVOTS):
        if len(rest) < 2 * _STAR:
            break
        pivot = rest[(2 * k + 1) * len(rest) // (2 * _PIVOTS)]
        near = _near(fps, rest, np.full(len(rest), pivot), bits, total)
        if near.sum() >= _STAR:
            label[rest[near]], rest = pivot, rest[~near]
    return label


def link(fps: np.ndarray, bits: int, total: int | None = None, cut: int = 0) -> np.ndarray:
    """A label for each row of fingerprints: equal for those that chains of links join.

    Rows link within `bits` in their first print and, if given, within `total` over all prints.  Where cut is not 0, all
    links between the rows before it and those from it on are found, and of the others perhaps some.  Tiles of 64 by 4096
    stay in the processor's cache; a tile whose rows and columns are one component already is left out.
    """
    fps = fps.astype(np.uint64)
    label = np.concatenate([_stars(fps[:cut], bits, total), cut + _stars(fps[cut:], bits, total)])
    order = np.concatenate([np.argsort(label[:cut], kind="stable"), cut + np.argsort(label[cut:], kind="stable")])
    fps, label = fps[order], label[order]
    first = np.ascontiguousarray(fps[:, 0])
    differ, count = np.empty((64, 4096), np.uint64), np.empty((64, 4096), np.uint8)
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a in range(0, cut or len(fps), 64):
        stop = min(a + 64, cut or len(fps))
        own, joins = label[a:stop], []
        for b in range(cut or a, len(fps), 4096):
            theirs = label[b : b + 4096]
            if own[0] == theirs[0] and (own == own[0]).all() and (theirs == own[0]).all():
                continue
            x, n = differ[: stop - a, : len(theirs)], count[: stop - a, : len(theirs)]
            np.bitwise_xor(first[a:stop, None], first[None, b : b + 4096], out=x)
            np.bitwise_count(x, out=n)
            i, j = np.nonzero(n <= bits)
            apart = own[i] != theirs[j]
            i, j = i[apart] + a, j[apart] + b
            if total is not None and len(i):
                near = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1) <= total
                i, j = i[near], j[near]
            if len(i):
                joins.append(label[i] * len(fps) + label[j])
        if joins:
            for x, y in (divmod(p, len(fps)) for p in np.unique(np.concatenate(joins)).tolist()):
                x, y = find(x), find(y)
                parent[max(x, y)] = min(x, y)
            names, place = np.unique(label, return_inverse=True)
            label = np.array([find(x) for x in names.tolist()])[place]
    out = np.empty(len(fps), np.int64)
    out[order] = label
    return out


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, each the place of its root, after rows a and b are joined: the lower root stays."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while ((up := label[label]) != label).any():
            label = up


def link_by_blocks(fps: np.ndarray, bits: int) -> np.ndarray:
    """As link() of one print: fingerprints within `bits` are equal in one of bits + 1 blocks of their 64 bits."""
    fps = np.ascontiguousarray(fps).view(np.uint64)
    label = np.arange(len(fps))
    ends = np.linspace(0, 64, bits + 2).astype(int)
    for low, high in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        key = fps >> np.uint64(low) & np.uint64((1 << (high - low)) - 1)
        order = np.argsort(key, kind="stable")
        begin = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        size = np.diff(np.r_[begin, len(order)])
        for at, n in zip(begin[size > RUN].tolist(), size[size > RUN].tolist(), strict=True):
            own = order[at : at + n]
            label = _merge(label, own, own[link(fps[own, None], bits)])
        left = np.repeat(np.where(size > RUN, 0, size), size) - (np.arange(len(order)) - np.repeat(begin, size)) - 1  # rows of the run beyond each
        place, step = np.flatnonzero(left > 0), 1
        while len(place):
            a, b = order[place], order[place + step]
            near = (label[a] != label[b]) & (np.bitwise_count(fps[a] ^ fps[b]) <= bits)
            if near.any():
                label = _merge(label, a[near], b[near])
            step += 1
            place = place[left[place] >= step]
    return label


def _verify(bits: int, prints: int, total: int | None):
    def run(key, table):
        _, i, j = (k.as_py() for k in key)
        sides: tuple[list, list] = ([], [])
        for part, x in zip(table.column("part").to_pylist(), table.column("members"), strict=True):
            sides[int(part != i)].append(np.frombuffer(x.as_buffer(), "<i8").reshape(-1, prints + 1))
        if i != j and not (sides[0] and sides[1]):
            return _EDGES.empty_table()
        member = np.concatenate([*sides[0], *sides[1]])
        if prints == 1 and total is None and len(member) > ALL:
            return stars(link_by_blocks(member[:, 0], bits), member[:, 1])
        return stars(link(member[:, :prints], bits, total, 0 if i == j else sum(map(len, sides[0]))), member[:, prints])

    return run


def near_links(nodes: DataFrame, bits: int, prints: int = 1, total: int | None = None) -> DataFrame:
    """Links u, v that join the nodes (node, fp; fp distinct) within `bits` of each other, as stars of each grid cell."""
    n = nodes.count()
    plan = _plan(n, bits) or wide_plan(n, prints)
    packed = durable(nodes.mapInArrow(_embed(plan, prints), "cell long, n long, members binary"))
    sizes = packed.groupBy("cell").agg(F.sum("n").alias("n"))
    if len(plan[0][0]):
        parts = sizes.filter(F.col("n") > PART).select("cell", F.ceil(F.col("n") / (PART / 2)).alias("parts"))
    else:  # one cell: its pairs of parts are all the tasks there are
        tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = sizes.select("cell", F.greatest(F.ceil(F.col("n") / (PART / 2)), F.least(F.lit(math.isqrt(4 * tasks)), F.ceil(F.col("n") / 64))).alias("parts"))
    dealt = packed.join(parts, "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    zero = F.lit(0).cast("long")
    whole = dealt.filter("parts = 1").select("cell", zero.alias("i"), zero.alias("j"), zero.alias("part"), "members")
    cut = dealt.filter("parts > 1").mapInArrow(_deal(prints), "cell long, i long, j long, part long, members binary")
    return whole.unionByName(cut).groupBy("cell", "i", "j").applyInArrow(_verify(bits, prints, total), "u long, v long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    seed: int = 42,
    bits: int = 4,
    prints: int = 1,
    total: int | None = None,
    distinct: bool = False,
) -> DataFrame:
    """Per row: id_col, sig (a hash of the text), fp (the bytes of its prints), component_id (the least id in reach).

    Rows link where their first prints differ in at most `bits` bits and, if `total` is given, all prints in at most
    `total`; rows without words have prints of zeros and link alike.  Rows that repeat an id each return.  A row with a
    null id links nothing and has a null component.
    """
    rows = durable(fingerprints(docs, id_col, text_col, words, seed, prints, distinct))
    nodes = durable(rows.filter("id is not null").groupBy("fp").agg(F.min("id").alias("node")))
    roots = components(near_links(nodes, bits, prints, total))
    classes = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    found = rows.join(classes, "fp", "left")
    return found.select(F.col("id").alias(id_col), "sig", "fp", F.expr("if(id is null, null, component_id)").alias("component_id"))


def similar_groups(sets: list[np.ndarray], least: float) -> np.ndarray:
    """A label for each set: equal for those that chains of links join.

    Sets, each without repeats, link where their Jaccard similarity is at least `least`; parity maps only spare the
    comparison of pairs that cannot be; empty sets are equal.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    end = np.cumsum(size)
    _, values = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    held = np.zeros(values.max(initial=-1) + 1, bool)
    maps = Maps(size, [parity(x) for x in sets], least)

    def near(x, rest):
        near = maps.near(x, rest)
        if not len(near):
            return near
        own = values[end[x] - size[x] : end[x]]
        held[own] = True
        stop = np.cumsum(size[near])
        inside = np.r_[0, np.cumsum(held[ragged(values, end[near] - size[near], size[near])])]
        held[own] = False
        common = inside[stop] - inside[stop - size[near]]
        return near[common >= least * (size[near] + size[x] - common) - 1e-9]

    return reached(len(sets), near)


def _similar_links(words: int, seed: int, least: float):
    """Stars u, v of the similar texts of a group, or of two parts of one."""

    def run(table):
        found = [shingle_set(t, words, seed) for t in table.column("text")]
        return stars(similar_groups(found, least), table.column("sig").to_numpy())

    return run


def first_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, seed: int = 42, least: float = 0.8) -> DataFrame:
    """id, sig (a hash of the text), n: of each group of similar texts the row of the least id, and how many rows it stands for.

    Texts link where the Jaccard similarity of their sets of `words`-word shingles is at least `least`, and chains of
    links make a group; no such pair is left out.  Texts without words are all similar.  A null id comes after all others.
    """
    found, rank = sets(docs, id_col, text_col, words, seed)
    roots = components(candidates(docs, found, rank, id_col, text_col, words, seed, least))
    found = found.join(roots, "node", "left").withColumn("cell", F.coalesce("root", "node"))
    rows = found.groupBy("id", "sig").agg(F.first("cell").alias("cell"), F.count(F.lit(1)).alias("n"))
    none = F.col("id").isNull().alias("none")
    texts = durable(rows.groupBy("sig").agg(F.min(F.struct(none, "id", "n", "cell")).alias("one")).select("sig", "one.*"))
    several = texts.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    several = several.select("cell", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))  # a cell may hold very many texts
    grouped = texts.withColumn("salt", F.pmod("sig", F.lit(SALTS)).cast("int")).join(several, ["cell", "salt"])
    held = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), F.col("text").cast("string")).withColumn("sig", F.xxhash64("text"))
    held = durable(same(held, grouped.select("id", "sig", "cell"), ["id", "sig"]).dropDuplicates(["id", "sig"]))
    sizes = held.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.sum(F.octet_length("text")).alias("bytes"))
    large = sizes.filter((F.col("size") > GROUP) | (F.col("bytes") > GROUP_BYTES))
    large = large.select("cell", F.ceil(F.greatest(F.col("size") / (GROUP / 2), F.col("bytes") / (GROUP_BYTES / 2))).cast("long").alias("parts"))
    dealt = held.join(F.broadcast(large), "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("sig"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("cell", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "sig", "text")
    links = dealt.groupBy("cell", "i", "j").applyInArrow(_similar_links(words, seed, least), "u long, v long")
    groups = texts.join(components(links), texts["sig"] == F.col("node"), "left").withColumn("group", F.coalesce("root", "sig"))
    return groups.groupBy("group").agg(F.min(F.struct("none", "id", "sig", "n")).alias("one")).select("one.id", "one.sig", "one.n")
