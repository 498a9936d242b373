"""The pipeline's stages on a small corpus, each against what it must keep."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from siltstone.llm import overlap, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, tmp_path):
    rng = random.Random(6)
    plain = [f"{a}{b}" for a in ("tion", "ea", "the", "wh", "or", "lin") for b in ("an", "st", "re", "ing", "ed")]
    rows, marks = [], []
    for i in range(240):
        words = [rng.choice(plain) + rng.choice(plain) for _ in range(80)]
        if i % 8 == 0:
            words[10:20:3] = ["idiot", "scum", "moron", "idiot"]
        text = " ".join(words[:40]) + "\n" + " ".join(words[40:])
        rows.append([i, f"{text}\nAll rights reserved." if i % 2 else text, "en", f"src{i % 15}", len(text)])
        if i % 2 == 0:
            marks.append((i, 1, int(i % 8 == 0)))
    rows += [[300, rows[1][1], "de", "src3", 5], [301, rows[3][1].replace(rows[3][1].split()[5], "edited", 1), "fr", "src4", 5], [302, "", "en", "src1", 0], [303, None, None, None, None], [None, "a text of its own", "en", "src1", 17]]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet"), rows


def test_stages(spark, tmp_path):
    docs, rows = corpus(spark, tmp_path)
    clean = P.toxicity(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    ids = {r.doc_id for r in clean.collect()}
    assert sum(i % 8 == 0 for i in ids if i is not None and i < 240) <= 2 and sum(i % 8 != 0 for i in ids if i is not None and i < 240) >= 205
    lines = P.line_dedup(spark, docs, str(tmp_path))
    assert lines.columns == docs.columns and lines.count() == docs.count()
    assert lines.filter("text like '%All rights%'").count() == 0
    near = P.near_dedup(spark, docs, str(tmp_path))
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in near.collect())
    assert near.columns == docs.columns
    assert kept == sorted([(False, i) for i in [*range(240), 302]] + [(True, 0)])
    mixed = P.mixing(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and 0.9 * docs.count() <= mixed.count() <= docs.count()
    ids = P.byte_bpe(spark, docs, str(tmp_path))
    assert ids.count() == docs.count()
    text = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("d"))
    assert ids.join(text, "doc_id").filter("d <> decoded_sha256").count() == 0


def test_run_and_empty_tables(spark, tmp_path):
    docs, _ = corpus(spark, tmp_path)
    out = P.run(spark, str(tmp_path))
    assert 150 < out.count() < 245 and out.filter("n_tokens <> size(ids)").count() == 0
    odd = docs.select("*", *[F.lit(7).alias(n) for n in ("TEXT", "Doc_ID", "_sig", "_score", "sig", "score", "n")])
    for _, stage in P.STAGES:
        assert stage(spark, odd, str(tmp_path)).count() > 150
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_line_dedup_keeps_texts_under_one_header_apart(spark, tmp_path):
    header = "A header line that opens very many different documents"
    rows = [[i, f"{header}\nown {i}\nAll rights reserved.", "en", f"src{i % 12}", 0] for i in range(24)]
    rows += [[100 + i, f"{header}\none page, copied", "en", f"src{i % 12}", 0] for i in range(24)]
    got = {r.doc_id: r.text for r in P.line_dedup(spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).collect()}
    assert got == {i: f"own {i}" for i in range(24)} | {100 + i: "one page, copied" for i in range(24)}


def brute_first(rows, words=5):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()

    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for a in sets:
        for b in sets:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return sorted(set(root.values()))


def edited_texts():
    """Base texts, each with copies in which so many words in a row are others: similarities around 0.8 on both sides."""
    rng = random.Random(9)
    rows = []
    for b in range(24):
        words = [f"w{rng.randrange(5000)}" for _ in range(60 + 10 * (b % 6))]
        rows.append((len(rows), " ".join(words)))
        for share in (0.02, 0.06, 0.1, 0.13, 0.2):
            n = round(share * len(words))
            rows.append((len(rows), " ".join(words[: len(words) - n] + [f"v{rng.randrange(5000)}" for _ in range(n)])))
            if share > 0.1:  # the same share in the middle, a near copy of none but perhaps the base
                rows.append((len(rows), " ".join([*words[:20], *(f"u{rng.randrange(5000)}" for _ in range(n)), *words[20 + n :]])))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", "one two", "One  TWO", "one", "a b c d e f", "a b c d e f g", "x y " * 40, "x y " * 4])]
    return rows


def test_near_copies_are_verified(spark, tmp_path, monkeypatch):
    rows = edited_texts()
    docs = spark.createDataFrame([[i, t, "en", "src1", 0] for i, t in rows], DOCS)
    want = brute_first(rows)
    assert 24 < len(want) < len(rows) - 24
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs, str(tmp_path)).collect()) == want
    monkeypatch.setattr(simhash, "GROUP", 4)
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs, str(tmp_path)).collect()) == want


def test_wide_grids_find_the_near_copies(spark, tmp_path, monkeypatch):
    rows = edited_texts()
    docs = spark.createDataFrame([[i, t, "en", "src1", 0] for i, t in rows], DOCS)
    monkeypatch.setattr(simhash, "CELL", 4)
    assert simhash.wide_plan(len(rows), 4)[0][0].shape == (6, 1)
    found, want = {r.doc_id for r in P.near_dedup(spark, docs, str(tmp_path)).collect()}, set(brute_first(rows))
    assert want <= found and len(found) <= len(want) + 0.02 * len(rows)


def test_near_copies_far_apart_in_sketches_are_found(spark, tmp_path, monkeypatch):
    """pairs of similarity 0.8 whose sketches differ in more bits than a sketch search looks at; members of many sets too."""
    rows = []
    for k in (1707, 2094, 3676, 13545, 18114, 29126):
        text = " ".join(f"{c}{k}" for c in "abcdefgh")
        rows += [(len(rows), text), (len(rows) + 1, f"{text} i{k}")]
    docs = lambda rows: spark.createDataFrame([[i, t, "en", "src1", 0] for i, t in rows], DOCS)
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs(rows), str(tmp_path)).collect()) == [0, 2, 4, 6, 8, 10] == brute_first(rows)
    rng, words = random.Random(2), [f"w{i}" for i in range(60)]
    for _ in range(30):  # near copies of one text, more than meet as pairs
        at = rng.randrange(60)
        rows.append((len(rows), " ".join([*words[:at], f"x{rng.randrange(99)}", *words[at + rng.randrange(5) :]])))
    rows += edited_texts_from(len(rows))
    want = brute_first(rows)
    for few, part in ((16, 8192), (2, 5)):
        monkeypatch.setattr(overlap, "FEW", few)
        monkeypatch.setattr(overlap, "PART", part)
        assert sorted(r.doc_id for r in P.near_dedup(spark, docs(rows), str(tmp_path)).collect()) == want


def edited_texts_from(first):
    return [(first + i, t) for i, t in edited_texts()]


def test_repeated_ids_and_very_long_texts(spark, tmp_path):
    long = " ".join(f"w{k * k % 9973}" for k in range(100_000))
    rows = [[1, "a text of one kind", "en", "s2", 1], [1, "another of the same id", "en", "s1", 2], [2, "another of the same id", "de", "s1", 3]]
    rows += [[3, long, "en", "s1", 4], [4, long + " end", "en", "s1", 5], [1, "a text of one kind", "en", "s1", 1]]
    got = P.near_dedup(spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).collect()
    assert sorted((r.doc_id, r.source, r.n_chars) for r in got) == [(1, "s1", 1), (1, "s1", 2), (3, "s1", 4)]


def test_near_copies_without_ids_meet_all_others(spark, tmp_path):
    """rows with a null id are compared too, and come after those with one."""
    text, other, own = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [[None, f"{text} end", "en", "s1", 1], [7, text, "en", "s2", 2], [None, f"{other} end", "de", "s1", 3], [None, other, "en", "s1", 4]]
    rows += [[None, other, "en", "s2", 5], [None, own, "en", "s1", 6], [9, None, None, None, None], [None, "", "en", "s1", 0]]
    got = P.near_dedup(spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, (r.text or "-")[0]) for r in got) == [(0, "b"), (0, "c"), (7, "a"), (9, "-")]
