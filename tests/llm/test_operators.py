"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import bpe, collision_ann, line_spread, mixing, page_diff, simhash, substring_dedup, topk, toxicity, warc
from siltstone.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS)


def sample_texts(seed=1, n=60):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "ééé", "日本"]
    passage = " ".join(rng.choice(words) for _ in range(40))
    out = []
    for i in range(n):
        t = " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(rng.randrange(0, 60)))
        out.append((i, f"{t}\n{passage} {t}" if i % 4 == 0 else t))
    return out + [(100, None), (101, ""), (102, " \t\n "), (103, out[0][1]), (104, out[0][1]), (105, "x " * 3000), (106, "x " * 2999)]


def clashing(df):
    """Columns that clash with the operators' own names, also in case."""
    return df.select("*", *[F.lit(7).alias(n) for n in ("TEXT", "ID", "sig", "bucket", "fp", "line", "rank", "score", "hits", "_node")])


# ---------------------------------------------------------------- substring dedup


def brute_windows(rows, w):
    first, words = {}, []
    for i, t in rows:
        ws = (t or "").encode().split()
        words.append(ws)
        for k in range(len(ws) - w + 1):
            s = b" ".join(ws[k : k + w])
            first[s] = min(first.get(s, i), i)
    out = {}
    for (i, _), ws in zip(rows, words, strict=True):
        gone = [False] * len(ws)
        for k in range(len(ws) - w + 1):
            if first[b" ".join(ws[k : k + w])] < i:
                gone[k : k + w] = [True] * w
        out[i] = (" ".join(x.decode() for x, g in zip(ws, gone, strict=True) if not g), len(ws), sum(gone))
    return out


@pytest.mark.parametrize("w", [3, 13])
def test_substring_dedup(spark, w):
    rows = sample_texts()
    got = substring_dedup.remove_repeated_windows(clashing(documents(spark, rows)).repartition(3), window=w).collect()
    assert {r.doc_id: (r.clean_text, r.n_words, r.n_removed) for r in got} == brute_windows(rows, w)
    for r in got:
        assert sum(b - a for a, b in r.spans) == r.n_removed
        assert all(b[0] > a[1] for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_substring_dedup_edges(spark):
    t = " ".join(map(str, range(20)))
    got = substring_dedup.remove_repeated_windows(documents(spark, [(None, t), (5, t), (5, t), (5, t + " more"), (2, None)])).collect()
    assert [(r.doc_id, r.n_removed) for r in got if r.n_removed] == []
    assert len(got) == 5
    assert substring_dedup.remove_repeated_windows(documents(spark, [])).count() == 0


def test_hot_passage_is_kept_once(spark):
    t = " ".join(map(str, range(30)))
    got = substring_dedup.remove_repeated_windows(documents(spark, [(i, f"{i}a {t}") for i in range(500)]).repartition(5)).collect()
    assert sorted(r.doc_id for r in got if r.n_removed == 0) == [0]
    assert {r.n_removed for r in got if r.doc_id} == {30}


# ---------------------------------------------------------------- SimHash


def brute_print(t, words):
    ws = (t or "").encode().lower().split()
    shingles = [b" ".join(ws[k : k + words]) for k in range(max(1, len(ws) - words + 1))] if ws else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles))


def brute_components(prints, bits):
    root = {i: i for i in prints}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


@pytest.mark.parametrize("bits", [0, 1, 4, 20])
def test_simhash(spark, bits):
    rows = sample_texts()
    got = simhash.near_duplicates(clashing(documents(spark, rows)), bits=bits).collect()
    prints = {i: brute_print(t, 4) for i, t in rows}
    assert {r.doc_id: int.from_bytes(r.fp, "big") for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == brute_components(prints, bits)


def flipped(rng, a, bits, wide=64):
    """Copies of fingerprints (bytes in rows) with so many bits flipped."""
    out = np.unpackbits(a, axis=1)
    for row in out:
        row[rng.choice(wide, bits, replace=False)] ^= 1
    return np.packbits(out, axis=1)


@pytest.mark.parametrize("n", [10, 1e6, 1e9])
def test_every_grid_finds_every_pair(n):
    rng = np.random.default_rng(3)
    for bits in (0, 1, 2, 3, 4, 7):
        plan = simhash._plan(n, bits)
        assert sum(r + 1 for _, r in plan) > bits or not len(plan[0][0])
        a = rng.integers(0, 256, (200, 8), dtype=np.uint8)
        x, y = np.unpackbits(a, axis=1), np.unpackbits(flipped(rng, a, bits), axis=1)
        near = np.zeros(200, bool)
        for segments, radius in plan:
            near |= np.abs(simhash._counts(x, segments) - simhash._counts(y, segments)).sum(axis=1) <= radius
        assert near.all()


@pytest.mark.parametrize("n", [1000, 200_000, 10**8])
def test_wide_grids_find_nearly_every_pair(n):
    rng = np.random.default_rng(4)
    plan = simhash.wide_plan(n, 4)
    a = rng.integers(0, 256, (1000, 32), dtype=np.uint8)
    x, y = np.unpackbits(a, axis=1), np.unpackbits(flipped(rng, a, 39, 256), axis=1)
    near = np.zeros(1000, bool)
    for segments, _ in plan:
        near |= (simhash._counts(x, segments) == simhash._counts(y, segments)).all(axis=1)
    assert near.mean() > 0.98


def test_simhash_splits_large_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 16)
    rows = sample_texts(n=95)
    got = simhash.near_duplicates(documents(spark, rows), bits=4).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components({i: brute_print(t, 4) for i, t in rows}, 4)


@pytest.mark.parametrize("radii, bits", [([0] * 5, 4), ([1, 1, 0], 4), ([2, 1], 4), ([0, 0], 1)])
@pytest.mark.parametrize("part", [16, 131072])
def test_each_grid_end_to_end(spark, monkeypatch, radii, bits, part):
    rng = np.random.default_rng(len(radii) + part)
    base = rng.integers(0, 256, (40, 8), dtype=np.uint8)
    fps = np.unique(np.concatenate([base, *(flipped(rng, base, k) for k in (1, 2, 3, 4, 4, 5, 6))]), axis=0)
    monkeypatch.setattr(simhash, "PART", part)
    monkeypatch.setattr(simhash, "_plan", lambda n, b: list(zip(np.array_split(simhash._SEGMENTS, len(radii)), radii, strict=True)))
    nodes = spark.createDataFrame([(i, bytearray(f.tobytes())) for i, f in enumerate(fps)], "node long, fp binary").repartition(3)
    roots = {r.node: r.root for r in components(simhash.near_links(nodes, bits)).collect()}
    want = brute_components({i: int.from_bytes(f.tobytes(), "big") for i, f in enumerate(fps)}, bits)
    assert {i: roots.get(i, i) for i in want} == want and len(set(want.values())) > 20


@pytest.mark.parametrize("cut", [0, 700])
def test_dense_cells_are_linked_right(cut):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 256, (3, 8), dtype=np.uint8)
    near = [flipped(rng, np.repeat(base[k : k + 1], n, axis=0), 2) for k, n in enumerate((600, 500, 3))]
    fps = np.concatenate([*near, rng.integers(0, 256, (300, 8), dtype=np.uint8)]).view(">u8").astype(np.uint64)
    fps = fps[rng.permutation(len(fps))]
    label = simhash.link(fps, 4, cut=cut)
    want = brute_components(dict(enumerate(fps[:, 0].tolist())), 4)
    assert len(set(label.tolist())) == len(set(want.values()))
    assert len({(label[i], want[i]) for i in want}) == len(set(want.values()))


def test_very_long_texts_are_hashed_in_blocks(spark):
    text = " ".join(f"w{k * k % 9973}" for k in range(150_000))
    got = simhash.near_duplicates(documents(spark, [(1, text), (2, text + " more"), (3, "short")])).collect()
    assert {r.doc_id: int.from_bytes(r.fp, "big") for r in got} == {1: brute_print(text, 4), 2: brute_print(text + " more", 4), 3: brute_print("short", 4)}


def test_simhash_edges(spark):
    got = simhash.near_duplicates(documents(spark, [(None, "a b"), (3, "a b"), (3, "a b"), (2, None), (1, "")])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id or 0) for r in got) == [(False, 1, 1), (False, 2, 1), (False, 3, 3), (False, 3, 3), (True, 0, 0)]
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_all_prints_must_agree(spark):
    a = " ".join(f"w{i}" for i in range(300))
    rows = [(1, a), (2, a.replace("w150 ", "other ")), (3, " ".join(f"v{i}" for i in range(300)))]
    got = simhash.near_duplicates(documents(spark, rows), words=5, bits=16, prints=4, total=46).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == 100


# ---------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def tokens():
    import public_tokenizers as P
    import tiktoken

    lines = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    return lines, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_the_library(spark, tokens):
    lines, pattern, library = tokens
    odd = ["ananananan", " aanededed", "aaaaaaaaaaaa" * 40, "<|endoftext|>", "I'll  we've\t\n\n x", "日本語 ééé 🤖🤖", " \x1c\x85 a", "0123456789" * 30, "x" * 5000]
    rows = [*sample_texts(), *((200 + i, t) for i, t in enumerate(odd)), (None, "null id")]
    got = bpe.decode(bpe.encode(clashing(documents(spark, rows)), lines, pattern), lines).collect()
    by_id = {r.doc_id: r for r in got}
    for i, t in rows:
        assert list(by_id[i].ids) == library.encode_ordinary(t or "")
        assert bytes(by_id[i].decoded) == (t or "").encode()
    assert bpe.encode(documents(spark, []), lines, pattern).count() == 0


def test_replay_equals_merging_alone(tokens):
    table = bpe.merges(tokens[0])
    rng = random.Random(5)
    pieces = list({"".join(rng.choice("aban ed") for _ in range(rng.randrange(1, 25))).encode() for _ in range(3000)})
    ids, count = table.replay(pieces)
    for piece, own in zip(pieces, np.split(ids, np.cumsum(count)[:-1]), strict=True):
        assert own.tolist() == ([table.rank[piece]] if piece in table.rank else table.alone(piece))


def bare(lines):
    """A vocabulary without shared pieces."""
    return bpe.Vocabulary(bpe.merges(lines), [], np.zeros(0, np.int32), np.zeros(0, np.int64))


def test_long_texts_are_taken_in_parts(tokens, monkeypatch):
    import regex

    monkeypatch.setattr(bpe, "LONG", 1000)
    monkeypatch.setattr(bpe, "_PIECES", 70)
    monkeypatch.setattr(bpe, "VOCABULARY", 300)
    text, vocabulary = " ".join(f"word{i % 900}x" for i in range(2000)), bare(tokens[0])
    sizes = []
    monkeypatch.setattr(vocabulary, "clear", lambda clear=vocabulary.clear: (sizes.append(vocabulary.size), clear()))
    assert [x.tolist() for x in vocabulary.encode(regex.compile(tokens[1]), ["short", None, text, "", "short one"])] == [tokens[2].encode_ordinary(t) for t in ("short", "", text, "", "short one")]
    assert sizes and max(sizes) < 2000  # what is learnt from one text stays bounded


def test_a_text_of_50_megabytes(tokens):
    import regex

    lines, pattern, library = tokens
    text = " ".join(f"{i % 70001:x}th wordling, {i % 13}" for i in range(2_700_000))
    assert len(text) > 50_000_000
    (got,) = bare(lines).encode(regex.compile(pattern), [text])
    assert np.array_equal(got, np.array(library.encode_ordinary(text), np.int32))
    assert bpe.merges(lines).decode(got) == text.encode()


def test_a_text_longer_than_a_chunk(spark, tokens):
    lines, pattern, library = tokens
    text = " ".join(f"{i % 70001:x}th wordling, {i % 13}" for i in range(300_000))
    assert len(text) > bpe.CHUNK_BYTES
    got = {r.doc_id: r for r in bpe.encode(documents(spark, [(1, text), (2, "x")]), lines, pattern, decoded=True).collect()}
    assert list(got[1].ids) == library.encode_ordinary(text) and bytes(got[1].decoded) == text.encode()


def test_each_piece_of_the_corpus_is_replayed_once(spark, tokens, monkeypatch):
    import regex

    lines, pattern, library = tokens
    rows = [(i, f"{t or ''} oddword{i % 7} weirdling") for i, t in sample_texts()]
    texts = documents(spark, rows).select("text").repartition(7)
    found = bpe.replayed(texts, lines, pattern).collect()
    want = {p for _, t in rows for p in regex.findall(pattern, t)}
    assert {r.piece for r in found} == want and len(found) == len(want)
    assert all(1 <= r.n <= 7 for r in found) and max(r.n for r in found) > 1
    assert all(list(r.ids) == library.encode_ordinary(r.piece) for r in found)
    shared = bpe.most_frequent(bpe.replayed(texts, lines, pattern), 1 << 20)
    ids = shared.column("ids").to_pylist()
    vocabulary = bpe.Vocabulary(bpe.merges(lines), shared.column("piece").to_pylist(), np.array([x for i in ids for x in i], np.int32), np.array([len(i) for i in ids], np.int64))
    monkeypatch.setattr(bpe.Merges, "replay", lambda *_: pytest.fail("a piece is replayed again"))
    assert [x.tolist() for x in vocabulary.encode(regex.compile(pattern), [t for _, t in rows])] == [library.encode_ordinary(t) for _, t in rows]


def test_only_the_most_frequent_pieces_are_shared(spark, tokens, monkeypatch):
    lines, pattern, library = tokens
    rows = [(i, "common words here " * 20 + f"rare{i}piece") for i in range(40)]
    monkeypatch.setattr(bpe, "COUNTED", 8)
    texts = documents(spark, rows).select("text")
    held = bpe.replayed(texts.repartition(4), lines, pattern)
    most = set(bpe.most_frequent(held, 80).column("piece").to_pylist())
    assert {" common", " words", " here"} <= most and not any(p.strip().isdigit() for p in most if p.strip() not in map(str, range(10)))
    assert bpe.most_frequent(held, 0).num_rows == 0
    for bound in (0, 80):
        monkeypatch.setattr(bpe, "SHARED", bound)
        assert {r.doc_id: list(r.ids) for r in bpe.encode(documents(spark, rows), lines, pattern).collect()} == {i: library.encode_ordinary(t) for i, t in rows}


def test_merging_alone_is_fast_and_right(tokens):
    table, library = bpe.merges(tokens[0]), tokens[2]
    rng = random.Random(12)
    for n in (0, 1, 2, 50, 700):
        piece = "".join(rng.choice("abn e") for _ in range(n))
        assert table.alone(piece.encode()) == (library._encode_single_piece(piece) if n else [])
    whole = bytes(rng.randrange(256) for _ in range(200000))
    assert b"".join(table.token[i] for i in table.alone(whole)) == whole


@pytest.mark.parametrize("kept", [0, 1 << 30])
def test_a_vocabulary_lasts_over_chunks(spark, tokens, monkeypatch, kept):
    lines, pattern, library = tokens
    import regex

    monkeypatch.setattr(bpe, "VOCABULARY", kept)
    vocabulary = bare(lines)
    for text in ("strange wordlings", "strange wordlings and otherlings", "otherlings " * 3):
        assert vocabulary.encode(regex.compile(pattern), [text])[0].tolist() == library.encode_ordinary(text)
        assert (len(vocabulary.number) == 0) == (kept == 0)
    rows = sample_texts()
    got = bpe.encode(documents(spark, rows), lines, pattern, decoded=True).collect()
    assert {r.doc_id: (list(r.ids), bytes(r.decoded)) for r in got} == {i: (library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows}
    assert bpe.encode(documents(spark, []), lines, pattern, decoded=True).columns == ["doc_id", "ids", "decoded"]


# ---------------------------------------------------------------- vectors


def test_large_and_tiny_components_keep_their_order(spark):
    for size in (1e200, 1.5e307, 1e-200):
        rows = [(0, [size, 0.0]), *((i, [size, size * i / 8]) for i in range(1, 8))]
        got = collision_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 7).orderBy("rank").collect()
        assert [r.vec_id for r in got] == [1, 2, 3, 4, 5, 6, 7]
        assert [r.score for r in got] == pytest.approx([size * i / 8 for i in range(1, 8)], rel=1e-12)



def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def random_vectors(n, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    out = [(i, [float(x) for x in np.float32(rng.standard_normal(dim))], 0) for i in range(n)]
    return [*out[:-30], *((n - 30 + k, out[5][1], 0) for k in range(30))]


BAD = [(9000, None, 0), (9100, [1.0, None] + [0.0] * 14, 0), (9200, [float("nan")] * 16, 0), (9300, [float("inf")] * 16, 0), (None, [1.0] * 16, 0), (9400, [], 0), (9500, [1.0, 2.0], 0)]


def test_top_products(spark):
    rows = random_vectors(700)
    got = topk.top_products(clashing(vectors(spark, rows + BAD)), F.col("vec_id") % 100 == 0).collect()
    whole = {i: [math.floor(1024 * x) for x in v] for i, v, _ in rows}
    want = {}
    for q in (i for i in whole if i % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:10]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in got} == want


def test_top_products_edges(spark):
    few = topk.top_products(vectors(spark, [(0, [1.0, 2.0], 0), (1, [1.0, 1.0], 0), (1, [1.0, 1.0], 0)]), F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id) for r in sorted(few, key=lambda r: r.rank)] == [(1, 1), (2, 1)]
    assert topk.top_products(vectors(spark, []), F.lit(True)).count() == 0
    large = spark.createDataFrame([(0, [1e17, 3.0]), (1, [1e17, -3.0]), (2, [1e300, 0.0])], "vec_id long, embedding array<double>")
    got = topk.top_products(large, F.col("vec_id") == 0).collect()
    assert {r.vec_id: r.score for r in got} == {1: 2**63 - 1, 2: 2**63 - 1}


def test_nearest_recall(spark):
    rows = random_vectors(2000, 32)
    got = collision_ann.nearest(clashing(vectors(spark, rows + BAD + [(9600, [0.0] * 32, 0)])), F.col("vec_id") % 50 == 0).collect()
    x = {i: np.array(v, float) for i, v, _ in rows}
    hit = total = 0
    for q in (i for i in x if i % 50 == 0):
        away = sorted((math.sqrt(((x[q] - v) ** 2).sum()), i) for i, v in x.items() if i != q)[:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert len(mine) == 10
        assert all(abs(s - math.sqrt(((x[q] - x[i]) ** 2).sum())) < 1e-12 for _, i, s in mine)
        hit, total = hit + len({i for _, i in away} & {i for _, i, _ in mine}), total + 10
    assert hit / total >= 0.9


def test_nearest_edges(spark):
    assert collision_ann.nearest(vectors(spark, []), F.lit(True)).count() == 0
    one = collision_ann.nearest(vectors(spark, [(0, [1.0], 0), (1, [2.0], 0), (2, [2.0], 0)]), F.col("vec_id") == 0).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in one) == [(1, 1, 1.0), (2, 2, 1.0)]


# ---------------------------------------------------------------- WARC


def test_warc_round_trip(spark, tmp_path):
    big, bigger = "é" * 600, "b" * 5000
    rows = [(1, "http://a/ü?x=1 2", big), (2, "http://a/2", big), (9, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "n", bigger), (-7, "m", bigger), (-7, "m", bigger), (8, "z", "x" * 3000000)]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    path = str(tmp_path / "w")
    warc.write_archives(pages, path)
    got = warc.read_archives(spark, path).collect()
    assert sorted((r.page_id or 0, r.url or "", r.payload_bytes, r.payload_digest) for r in got) == sorted((i or 0, u or "", len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, u, h in rows)
    kinds = sorted(((r.page_id or 0), r.record_type, r.refers_to or 0) for r in got)
    assert kinds == sorted([(1, "revisit", 9), (2, "revisit", 9), (9, "response", 0), (3, "response", 0), (4, "response", 0), (5, "response", 0), (6, "response", 0), (0, "revisit", -7), (-7, "response", 0), (-7, "response", 0), (8, "response", 0)])
    assert all(bytes(r.payload) == dict((i, h or "") for i, _, h in rows)[r.page_id].encode() for r in got if r.record_type == "response")


def test_warc_empty_and_broken(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0
    good = warc.record(1, "u", b"abc", 3, hashlib.sha1(b"abc").hexdigest(), None, "1970-01-01T00:00:00Z")
    assert warc.parse(good)[:4] == (1, "u", "response", 3)
    for bad in (good[:-1], good.replace(b"abc", b"abd"), good.replace(b"Content-Length: 3", b"Content-Length: 4"), good.replace(b"WARC-Date", b"Other"), b"junk"):
        with pytest.raises(ValueError):
            warc.parse(bad)
    packed = warc.archive([good] * 3)
    assert [d for _, d in warc.frames(memoryview(packed))] == [good] * 3
    with pytest.raises(ValueError):
        list(warc.frames(memoryview(packed[:-3])))
    with pytest.raises(ValueError):
        list(warc.frames(memoryview(b"\0" * 20)))


# ---------------------------------------------------------------- line spread


def brute_lines(rows, least):
    """Lines of two or more different texts that stand on `least` sites go."""
    texts, sites = {}, {}
    for _, t, s in rows:
        for line in {x.strip(" ") for x in (t or "").split("\n")} - {""}:
            texts.setdefault(line, set()).add(t)
            sites.setdefault(line, set()).add(s)
    gone = {line for line, s in sites.items() if len(s) >= least and len(texts[line]) > 1}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" ") not in gone)) for i, t, _ in rows]


def test_boilerplate_of_syndicated_texts_goes(spark):
    """Articles that each stand on all sites: their common line is boilerplate, their own lines are not."""
    rows = [(20 * a + s, f"Article {a} begins\nSubscribe to our newsletter\nand ends {a}", f"site{s}") for a in range(50) for s in range(20)]
    got = line_spread.remove_spread_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), 10).collect()
    assert sorted((r.doc_id, r.clean_text, r.n_removed) for r in got) == [(i, t.replace("Subscribe to our newsletter\n", ""), 1) for i, t, _ in rows]


def test_hot_and_cold_lines_are_found_alike(spark, monkeypatch):
    rows = [(i, f"own {i}\nall\n{'half' if i % 2 else 'other'}\nfew {i % 40}", f"s{i % 15}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(brute_lines(rows, 12))
    monkeypatch.setattr(line_spread, "HOT_ROWS", 0)
    for share in (3, 10, 100_000):
        monkeypatch.setattr(line_spread, "HOT", share)
        assert sorted((r.doc_id, r.clean_text) for r in line_spread.remove_spread_lines(docs, 12).collect()) == want


def test_frames_without_their_size_are_read():
    import zstandard

    whole = zstandard.ZstdCompressor(write_content_size=False).compress(b"x" * 100000)
    assert list(warc.frames(memoryview(whole + whole))) == [(0, b"x" * 100000), (len(whole), b"x" * 100000)]


def test_line_spread(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join([f"own {i} {rng.random()}", *(rng.choice(["menu", " menu ", "all rights", "", "rare a"]) for _ in range(4))]), f"s{i % 12}") for i in range(150)]
    rows += [(200 + i, "copied text of one page\nwith lines\nthat many sites hold", f"s{i % 12}") for i in range(40)]
    rows += [(300, None, "s1"), (301, "", None), (302, "menu", None), (None, "menu\nx", "s2"), (302, "menu", None)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = line_spread.remove_spread_lines(docs, 10).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted([(r.doc_id, r.clean_text) for r in got], key=key) == sorted(brute_lines(rows, 10), key=key)
    assert all(r.clean_text for r in got if 200 <= (r.doc_id or 0) < 240)
    assert line_spread.remove_spread_lines(docs.limit(0), 10).count() == 0


def test_a_banner_over_many_sites_goes(spark):
    banner = "Welcome to the network of sites that all begin with this line"
    rows = [(i, f"{banner}\nbody {i}\n{banner}\n\nfooter of all", f"src{i % 20}") for i in range(200)]
    rows += [(300, "\n".join(f"line {k % 7000}" if k % 3 else "footer of all" for k in range(60000)), "src1"), (301, "w" * 3_000_000 + "\n" + banner, "src2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.clean_text, r.n_lines, r.n_removed) for r in line_spread.remove_spread_lines(docs, 10).collect()}
    assert all(got[i] == (f"body {i}\n", 5, 3) for i in range(200))
    assert got[300][1:] == (60000, 20000) and "footer" not in got[300][0]
    assert got[301] == ("w" * 3_000_000, 2, 1)


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(f"{n}", f"o{k}", k * 7919 + n) for n in range(1, 40) for k in range(n)]
    lines = spark.createDataFrame([(int(a), i, s) for i, (a, _, s) in enumerate(rows)], "line long, copy long, site long")
    assert sorted(r.line for r in line_spread.spread_lines(lines, 20).collect()) == list(range(20, 40))


# ---------------------------------------------------------------- mixing


def test_budgets_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "s1", 10), ("a", "x", "s2", 100), ("a", "y", "s1", 100), ("b", "x", "s1", 1000)], "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(leaves, {}, 200, 1).collect()}
    assert got == {("a", "x", "s1"): 10, ("a", "x", "s2"): 40, ("a", "y", "s1"): 50, ("b", "x", "s1"): 100}
    more = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(leaves, {}, 600, 1).collect()}
    assert more == {("a", "x", "s1"): 10, ("a", "x", "s2"): 100, ("a", "y", "s1"): 100, ("b", "x", "s1"): 390}
    assert sum(r.budget for r in mixing.leaf_budgets(leaves, {}, 10**9, 2).collect()) == 2 * 1210


def test_mixture_is_a_prefix_of_seeded_epochs(spark):
    rows = sample_texts(n=80)
    docs = clashing(documents(spark, rows + [(None, "one two"), (7, rows[7][1])]).withColumn("source", F.lit("s1")))
    got = mixing.mix(docs, F.lit("d"), {}, 5000, 3, seed=5).collect()
    assert sum(r.epochs * r.n_tokens + r.partial for r in got) == min(5000, 3 * sum(r.n_tokens for r in got))
    order = sorted(got, key=lambda r: (hashlib.md5(f"5:{r.epochs}:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest(), r.sig))
    cut = [r.partial == r.n_tokens for r in order if r.n_tokens]
    assert cut == sorted(cut, reverse=True)
    assert mixing.mix(docs.limit(0), F.lit("d"), {}, 10).count() == 0
    assert sum(r.partial for r in mixing.mix(docs, F.lit("d"), {}, 0).collect()) == 0


# ---------------------------------------------------------------- toxicity


def toxic_rows(n=400, seed=8):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("tion", "ea", "the", "wh", "or") for b in ("an", "st", "re", "ing")]
    rows, marks = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(60)]
        bad = i % 8 == 0
        if bad:
            words += [rng.choice(["idiot", "lowei" + rng.choice(plain), "scum!"]) for _ in range(4)]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        if i % 3 == 0:
            marks.append((i, 1, int(bad)))
    return rows, marks


def test_toxicity(spark):
    rows, marks = toxic_rows()
    docs, labels = documents(spark, rows + [(900, None), (901, ""), (None, "idiot scum")]), spark.createDataFrame([*marks, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    held = F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.train(clashing(docs), labels, ~held)
    got = {r.doc_id: r.score for r in toxicity.score(clashing(docs), model).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= s <= 1 for s in got.values())
    test = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 8 == 0) for i in test]) > 0.9
    assert got[900] == got[901] < 0.5 < got[None]
    assert toxicity.score(documents(spark, []), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = documents(spark, [(1, "a"), (2, "b")])
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert all(r.score < 0.5 for r in toxicity.score(docs, model).collect())


def dense_descent(x_p, x_u, prior, steps=300, rate=0.1, decay=1e-3):
    """Non-negative positive-unlabelled risk on dense matrices, its gradient by the chain rule, row by row."""
    d = x_p.shape[1]
    theta, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    theta[d] = math.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        s_p = [1 / (1 + math.exp(-min(max(float(r @ theta[:d] + theta[d]), -40), 40))) for r in x_p]
        s_u = [1 / (1 + math.exp(-min(max(float(r @ theta[:d] + theta[d]), -40), 40))) for r in x_u]
        as_clean_p, as_clean_u = sum(s_p) / len(s_p), sum(s_u) / len(s_u)
        up, down = np.zeros(d + 1), np.zeros(d + 1)  # gradients of R_p(+) and of R_u(-) - prior * R_p(-)
        for r, s in zip(x_p, s_p, strict=True):
            slope = s * (1 - s) / len(s_p) * np.append(r, 1)
            up -= slope
            down -= prior * slope
        for r, s in zip(x_u, s_u, strict=True):
            down += s * (1 - s) / len(s_u) * np.append(r, 1)
        grad = prior * up + down if as_clean_u >= prior * as_clean_p else -down
        grad[:d] += decay * theta[:d] / d
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        theta[:d] = np.maximum(theta[:d], 0)
    return theta[:d], theta[d]


def test_descent_equals_a_dense_one():
    rng = np.random.default_rng(3)
    x_p, x_u = (rng.random((40, 6)) < 0.8).astype(float), (rng.random((90, 6)) < 0.1).astype(float)
    x_u[:20] = x_p[:20]
    lists = [(*np.nonzero(x), len(x)) for x in (x_p, x_u)]
    for prior, steps in ((0.2, 60), (0.7, 60)):  # at 0.7 the clean risk goes below zero
        w, b = toxicity.descend(*lists, 6, prior, steps)
        dense_w, dense_b = dense_descent(x_p, x_u, prior, steps)
        assert np.allclose(w, dense_w, atol=1e-9) and abs(b - dense_b) < 1e-9 and w.max() > 0.1


def test_feature_counts_cover_all_rows(spark):
    texts = ["idiot fool", "fool fool", None, "", "other"] * 40
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    counts = {r.feature: r.n for r in toxicity._counts(df).collect()}
    import pyarrow as pa

    word = set(toxicity.features(pa.array(["fool"]))[1].tolist())
    assert counts[-1] == 200 and all(counts[f] == 80 for f in word)


def test_toxicity_edges(spark, monkeypatch):
    rows, marks = toxic_rows(240)
    rows += [(0, rows[0][1]), (0, rows[0][1]), (1000, "plain words " * 200_000), (1001, "plain words " * 200_000 + "idiot scum! idiotea")]
    marks += [(0, 1, 0), (3, 1, 0), (3, 1, 0)]  # an id of two labels counts as toxic
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.train(documents(spark, rows), labels, F.lit(True))
    got = [(r.doc_id, r.score) for r in toxicity.score(documents(spark, rows), model).collect()]
    assert len(got) == len(rows)
    by_id = dict(got)
    assert by_id[0] > 0.5 > by_id[1] and by_id[1000] < 0.5
    monkeypatch.setattr(toxicity, "MOST_UNLABELLED", 50)
    few = toxicity.train(documents(spark, rows), labels, F.lit(True))
    assert np.isfinite(few.weights).all() and few.weights.max() > 0  # the counts still choose the same features


# ---------------------------------------------------------------- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="with-sidebar">
<header><a href=/>Home</a></header><nav><ul><li>One<li>Two</ul></nav><!-- ad <p>no</p> --><div class="ad">Buy</div><aside>Side</aside>
<article><header><h1>Head &amp; line</h1></header><p><b>First  para<br><p>Second&nbsp;one <i>in</i>line<div class="share-box">Share</div>
<section id="comments"><article class="comment">Nice!</article></section><form>Mail <input name=x></form></article>
<div class="cookie-notice">Cookies</div><footer>&copy; x</footer></body></html>"""


def test_article_text():
    assert page_diff.main_text(page_diff.lines_of(PAGE), set()) == "Head & line First para Second one inline"
    assert page_diff.lines_of("") == [] and page_diff.lines_of("<p") == [("<p", 0)]
    assert page_diff.main_text(page_diff.lines_of("<article><p>open <b>end"), set()) == "open end"
    assert page_diff.main_text(page_diff.lines_of("<article>a<script>x<!-- </article>"), set()) == "a"
    assert page_diff.main_text(page_diff.lines_of("a<main>b<article>c</article>d</main>"), set()) == "c"
    assert page_diff.main_text(page_diff.lines_of("a<main><header>b</header>c</main>"), set()) == "b c"
    assert page_diff.main_text(page_diff.lines_of("<article>" + "<div>" * 5000 + "deep"), set()) == "deep"


def brute_lcs(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
    return best[-1, -1]


@pytest.mark.parametrize("limit", [1 << 26, 4])
def test_longest_common_subsequence(monkeypatch, limit):
    rng = random.Random(limit)
    align = page_diff._align
    if limit == 4:  # force the halving
        import types

        code = align.__code__.replace(co_consts=tuple(limit if c == 1 << 26 else c for c in align.__code__.co_consts))
        monkeypatch.setattr(page_diff, "_align", types.FunctionType(code, page_diff.__dict__))
    for _ in range(100):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(12))] for _ in range(2))
        places = page_diff.shared(a, b)
        assert len(places) == brute_lcs(a, b) and places == sorted(set(places))
        rest = iter(b)
        assert all(a[i] in rest for i in places)


def test_pages_without_an_article_lose_shared_lines(spark):
    frame = "<div>Site name</div><div>{}</div><div>Imprint</div>"
    rows = [(i, f"http://h.example/en/{i}.html", frame.format(f"text {i}")) for i in range(20)]
    rows += [(50, "http://alone.example/1", frame.format("only")), (51, None, None), (52, "http://h.example/en/1.html?x", frame.format("text 1")), (None, "http://[bad", "<article>a</article>"), (51, None, None)]
    got = page_diff.extract(clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert all(text[i] == f"text {i}" for i in range(20)) and text[52] == "text 1"
    assert text[50] == "Site name only Imprint" and text[51] == "" and text[None] == "a"
    assert page_diff.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_extract(rows):
    """Each page without an article element against its nearest-URL page that is no copy, all pages of a host at hand."""
    lines = {i: page_diff.lines_of(h or "") for i, _, h in rows}
    out = {}
    for i, url, _ in rows:
        own, host, path = lines[i], *page_diff._place(url)
        if any(p == page_diff._ARTICLE for _, p in own):
            out[i] = " ".join(t for t, p in own if p == page_diff._ARTICLE)
            continue
        body = page_diff._MAIN if any(p == page_diff._MAIN for _, p in own) else page_diff._PLAIN
        others = [(page_diff._common(path, page_diff._place(u)[1]), lines[j]) for j, u, _ in rows if page_diff._place(u)[0] == host and lines[j] != own]
        best = max(others, key=lambda x: x[0], default=(0, []))[1]
        kept = [x for x in own if x not in best and x[1] == body]  # lines stand once in a page of this fixture: shared means common
        assert len(own) == len(set(own)) and brute_lcs([x for x in own if x in best], [x for x in best if x in own]) == sum(x in best for x in own)
        out[i] = " ".join(t for t, _ in kept)
    return out


def site_pages():
    """Hosts of pages in sections with a template of their own; some with main or article elements, some of template lines only."""
    rng, rows = random.Random(8), []
    for h in range(4):
        for section in range(5):
            frame = f"<div>Site {h}</div><div>Section {section} of {h}</div>{{}}<p>Contact {h}</p><nav>menu {{}}</nav>"
            for k in range(6):
                i = len(rows)
                text = "".join(f"<p>text {i} {j} {rng.random()}</p>" for j in range(rng.randrange(1, 6)))
                inner = ["<div>{}</div>", "<main><h2>Our main {h}</h2>{}</main>", "<article>{}</article>"][i % 3 if h == 3 else 0].replace("{}", text).replace("{h}", str(h))
                rows.append((i, f"http://h{h}.example/s{section}/page{k}/x", frame.format("" if h == 2 and k == 2 else inner, i)))
    return rows


def test_differencing_against_brute_force(spark):
    rows = site_pages()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in page_diff.extract(pages).collect()}
    assert got == brute_extract(rows)
    assert [i for i, u, _ in rows if not got[i]] == [i for i, u, _ in rows if "h2.example" in u and "/page2/" in u]
    off = {r.page_id: r.text for r in page_diff.extract(pages, near=0).collect()}
    assert all((off[i] != got[i]) == ("<article>" not in h) for i, _, h in rows if "<main>" not in h)


def test_partners_are_sought_past_copies():
    def entry(path, *texts):
        return {"host": "h", "path": path, "lines": b"".join(xxhash.xxh64_digest(t) + bytes([0]) for t in texts)}

    page, copy, near, other = entry("/a/1", *"TabcF"), entry("/a/2", *"TbacF"), entry("/a/3", *"TabcF", *"x"), entry("/b/1", *"TzF")
    places = lambda around: np.frombuffer(page_diff.template_lines("h", "/a/1", page["lines"], around), "<u4").tolist()
    assert places([copy, other]) == [0, 4] and places([copy]) == [] and places([]) == []
    many = [str(k) for k in range(30)]
    page, near = entry("/a/1", *many), entry("/a/2", *many, "x")
    assert places([near, entry("/b", "0", "z")]) == [0] and places([near]) == list(range(30))


def test_a_very_long_page(spark):
    body = "".join(f"<p>line {k}</p>" for k in range(40_000))
    rows = [(1, "http://h.e/a", f"<div>top</div>{body}<div>end</div>"), (2, "http://h.e/b", "<div>top</div><p>own</p><div>end</div>")]
    got = {r.page_id: r.text for r in page_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "own" and got[1] == " ".join(f"line {k}" for k in range(40_000))


def test_copies_of_a_page_are_cleaned_alike(spark):
    frame = "<div>Site name</div><div>{}</div><div>Imprint</div>"
    rows = [(i, f"http://h.example/en/{i // 7}?x={i}", frame.format(f"text {i // 7}")) for i in range(35)]
    got = page_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"text {i // 7}" for i in range(35)} and len(got) == 35


def test_template_lines_inside_articles_go(spark):
    """pages with an article are differenced too; lines that some of the pages around repeat are their own text."""
    frame = "<nav>menu {0}</nav><article><p>Read by the editors</p><h1>Title {0}</h1>{1}<p>text {0}</p><p>more {0}</p><p>All our stories</p></article>"
    said = lambda i: "<p>A common saying</p>" if i % 3 == 0 else ""
    rows = [(i, f"http://h.example/en/{i:02}", frame.format(i // 2, said(i // 2))) for i in range(24)]  # each page twice
    rows += [(100 + i, f"http://few.example/{i}", frame.format(i, "")) for i in range(3)]
    got = {r.page_id: r.text for r in page_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i // 2} {'A common saying ' if i // 2 % 3 == 0 else ''}text {i // 2} more {i // 2}" for i in range(24))
    assert all(got[100 + i] == f"Read by the editors Title {i} text {i} more {i} All our stories" for i in range(3))


@pytest.mark.parametrize("run", [512, 40])
def test_blocks_of_bits_link_as_all_pairs_do(monkeypatch, run):
    """a cell's members meet by equal blocks of bits, with the components of comparing all with all, in far less time."""
    monkeypatch.setattr(simhash, "RUN", run)
    rng = np.random.default_rng(11)
    base = rng.integers(0, 256, (400, 8), dtype=np.uint8)
    copies = [flipped(rng, base, k) for k in range(1, 7)]
    dense = [flipped(rng, np.repeat(base[:1], 300, axis=0), k) for k in (2, 3)]
    fps = np.unique(np.concatenate([base, *copies, *dense]).view(">u8").astype(np.uint64))
    for bits in (0, 3, 4, 8):
        label, want = simhash.link_by_blocks(fps, bits), simhash.link(fps[:, None], bits)
        assert len({*zip(label.tolist(), want.tolist(), strict=True)}) == len({*label.tolist()}) == len({*want.tolist()})
    many = np.random.default_rng(5).integers(0, 2**63, 40_000, np.int64)
    tiles = []
    monkeypatch.setattr(simhash, "link", lambda *x: tiles.append(x))
    found = simhash._verify(4, 1, None)([pa.scalar(0)] * 3, pa.table({"part": [0], "members": [np.column_stack([many, np.arange(len(many))]).tobytes()]}))
    assert not tiles and found.num_rows < 10
