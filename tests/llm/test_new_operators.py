"""Merkle manifest, URL filters and importance resampling against brute force, and on nulls, repeats, hot groups, empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siltstone.llm import importance, merkle, url_filter
from siltstone.llm.common import numbered
from test_operators import DOCS, clashing, documents, sample_texts

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- places in groups


def test_numbered_deals_hot_groups_and_repeats(spark):
    rows = [("a", 5)] * 300 + [("b", i) for i in range(50)] + [(None, 1), (None, None)]
    df = numbered(spark.createDataFrame(rows, "g string, v long").repartition(5), ["g"], ["v"])
    got = defaultdict(list)
    for r in df.collect():
        got[r.g].append((r.pos, r.v, r.size))
    assert {g: sorted(x) for g, x in got.items()} == {
        "a": [(i, 5, 300) for i in range(300)],
        "b": [(i, i, 50) for i in range(50)],
        None: [(0, None, 2), (1, 1, 2)],
    }
    base = spark.createDataFrame([("a", 10), ("b", 20), (None, 30)], "g string, first long")
    assert {r.g: r.p for r in numbered(df.select("g", "v"), ["g"], ["v"], base).groupBy("g").agg(F.min("pos").alias("p")).collect()} == {"a": 10, "b": 20, None: 30}


# ---------------------------------------------------------------- manifest


def levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([sha("".join(last[i : i + arity])) for i in range(0, len(last), arity)])
    return out


def path(tree, at, arity):
    out = []
    for level in tree[:-1]:
        run = level[at // arity * arity : at // arity * arity + arity]
        out.append(("".join(run[: at % arity]), "".join(run[at % arity + 1 :])))
        at //= arity
    return out


def brute_manifest(rows, arity):
    """(id, leaf, subroot, root, proof digest) of rows (id, text, lang, source, n_chars), sorted."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for i, t, lang, source, n in rows:
        groups[source].append(((i is not None, i or 0, sha("".join(map(enc, (i, source, lang, n, t))))), i))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([k[2] for k, _ in sorted(groups[s], key=lambda x: x[0])], arity) for s in order}
    whole = levels([trees[s][-1][0] for s in order], arity)
    out = []
    for j, s in enumerate(order):
        for at, (k, i) in enumerate(sorted(groups[s], key=lambda x: x[0])):
            steps = path(trees[s], at, arity) + path(whole, j, arity)
            out.append((i, k[2], trees[s][-1][0], whole[-1][0], sha("".join(a + b for a, b in steps))))
    return sorted(out, key=repr)


def manifest_rows(df):
    got = df.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest("proof").alias("p"), merkle.fold(F.col("leaf"), "proof").alias("folded")).collect()
    assert all(r.folded == r.root for r in got)
    return sorted([tuple(r)[:5] for r in got], key=repr)


@pytest.mark.parametrize(("arity", "height", "n"), [(3, 2, 200), (2, 1, 40), (3, 5, 200), (4, 2, 17)])
def test_manifest(spark, arity, height, n):
    rng = random.Random(n)
    rows = [(i, rng.choice(["a\nb", "", None, "é" * rng.randrange(9)]), rng.choice(["en", None]), rng.choice(["hot", "hot", "s1", "s2", "ä", None, ""]), rng.choice([None, i])) for i in range(n)]
    rows += [(None, "x", "en", "s1", 1), (3, "again", None, "hot", 2), (7, "same", None, "s2", 1), (7, "same", None, "s2", 1)]
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    got = merkle.manifest(clashing(df), FIELDS, arity=arity, height=height)
    assert manifest_rows(got) == brute_manifest(rows, arity)


def test_manifest_of_one_row_many_sources_and_none(spark):
    one = [(5, "t", "en", None, 1)]
    got = merkle.manifest(spark.createDataFrame(one, DOCS), FIELDS).collect()
    assert len(got) == 1 and got[0].leaf == got[0].subroot == got[0].root and got[0].proof == [] and got[0].source is None
    many = [(i, "t", "en", f"s{i:03d}", i) for i in range(60)]  # more sources than a block holds at height 2
    assert manifest_rows(merkle.manifest(spark.createDataFrame(many, DOCS), FIELDS, height=2)) == brute_manifest(many, 3)
    assert merkle.manifest(spark.createDataFrame([], DOCS), FIELDS).count() == 0


def test_changed_leaves_fold_to_another_root(spark):
    rows = [(i, f"line {i}\nend", "en", "s", 1) for i in range(30)]
    found = merkle.manifest(spark.createDataFrame(rows, DOCS), FIELDS, height=2, carry={"other": F.upper("text")})
    roots = {r.doc_id: (r.root, r.f, r.other) for r in found.withColumn("f", merkle.fold(F.sha2(F.col("other").cast("binary"), 256), "proof")).collect()}
    assert all(f != root and other == f"LINE {i}\nEND" for i, (root, f, other) in roots.items())


def test_traversal_by_hand():
    a, b, c, d = (hashlib.sha256(bytes([i])).digest() for i in range(4))
    h = lambda *x: hashlib.sha256(b"".join(x).hex().encode()).digest()
    top, paths = merkle.traverse([a, b, c, d], 2, 3)
    assert top == h(h(a, b, c), h(d))
    assert paths == [[(b"", b + c), (b"", h(d))], [(a, c), (b"", h(d))], [(a + b, b""), (b"", h(d))], [(b"", b""), (h(a, b, c), b"")]]
    assert merkle.traverse([a], 0, 3) == (a, [[]])


# ---------------------------------------------------------------- URL filters


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.Example.com", "/en/", "allow"), ("net", "/e", "block"), ("net", "", "allow"), ("a.b", "/x/y", "block"), ("b", "/x/y/z", "allow"), ("b", "/x/y/zz", "block"), ("b", "/x/y/zz", "allow"), ("", "/q", "block")]


def brute_verdict(url, rules):
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    tail = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = lower(host)
    fit = [(len(h + p), len(h), v == "block", h + p) for h, p, v in ((lower(h or ""), p or "", v) for h, p, v in rules) if (host == h or host.endswith("." + h)) and tail.startswith(p)]
    best = max(fit, default=None)
    return host, tail, best and best[3], "block" if best and best[2] else "allow"


URLS = [None, "", "no scheme", "http://", "http://COM", "https://x.example.com/en/a?b=/c#d", "https://www.example.com/en/", "https://www.example.com/en", "ftp://ÄB.net/es/1", "a://b://net/e", "http://n.net?x=/en/", "http://net#/e", "http://c.a.b/x/yy", "http://a.b/x/y", "http://b/x/y/zzz", "http://x./q/1", "http:///q", "http://example.com:80/en/", "http://fooexample.com/en/x", "http://h.net/" + "e/" * 50_000, "http://" + "l." * 20_000 + "com/en/"]


@pytest.mark.parametrize("prefix", [8, 1])
def test_url_rules(spark, monkeypatch, prefix):
    """With one hex digit many expressions meet rules of other digests."""
    monkeypatch.setattr(url_filter, "PREFIX", prefix)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(None, URLS[5]), (5, URLS[5])], "page_id long, url string")
    for rules in (RULES, RULES[:1], []):
        listed = spark.createDataFrame(rules, "host string, path string, verdict string")
        got = url_filter.judge(pages.select("*", F.lit(1).alias("host"), F.lit(2).alias("URL"), F.lit(3).alias("row")).repartition(3), listed)
        want = [(i, *brute_verdict(u, rules)) for i, u in [*enumerate(URLS), (None, URLS[5]), (5, URLS[5])]]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_url_rules_drawn(spark):
    rng = random.Random(3)
    host = lambda: ".".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
    tail = lambda: "".join("/" + "".join(rng.choice("xy") for _ in range(rng.randrange(3))) for _ in range(rng.randrange(4)))
    rules = [(host(), tail(), rng.choice(["allow", "block"])) for _ in range(150)]
    urls = [f"http://{host()}{tail()}" for _ in range(400)]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert {r.page_id: tuple(r)[1:] for r in got.collect()} == {i: brute_verdict(u, rules) for i, u in enumerate(urls)}


def test_url_rules_edges(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none, spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert url_filter.judge(pages, spark.createDataFrame([(None, None, "block")], "host string, path string, verdict string"), "block").collect()[0].verdict == "block"
    with pytest.raises(Exception, match="no verdict"):
        url_filter.judge(pages, spark.createDataFrame([("a", "/", "maybe")], "host string, path string, verdict string")).collect()


def test_url_rules_stay_in_the_jvm(spark):
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    plan = url_filter.judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


# ---------------------------------------------------------------- importance resampling


def brute_features(text, runs):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return ws, [" ".join(ws[i : i + n]) for n in range(1, runs + 1) for i in range(len(ws) - n + 1)]


def brute_resample(rows, target, percent, least, seed, buckets, runs):
    cut = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(cut(f) for _, t in rows for f in brute_features(t, runs)[1])
    t = Counter(cut(f) for x in target for f in brute_features(x, runs)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        ws, fs = brute_features(text, runs)
        w = sum(gain[cut(f)] for f in fs)
        h = int(sha(f"{seed}:{'' if i is None else i}")[:8], 16)
        out.append([i, len(ws), len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    drawn = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[1:]))
    n = len(drawn) * percent // 100
    return sorted([(*r, drawn.index(r) + 1) for r in drawn[:n]] + [(*r, None) for r in drawn[n:]] + [(*r, None) for r in out if r[1] < least], key=repr)


@pytest.mark.parametrize(("runs", "percent", "buckets"), [(1, 10, 10_000), (2, 50, 37), (3, 100, 500), (1, 0, 10)])
def test_resampling(spark, runs, percent, buckets):
    rows, target = sample_texts(5, 80), ["Alpha beta 日本 ééé zeta3", None, "", "alpha. BETA! alpha"]
    df = clashing(documents(spark, rows)).repartition(5)
    found = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent, 10, 7, buckets, runs)
    assert found.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute_resample(rows, target, percent, 10, 7, buckets, runs)


def test_ranks_of_ties_and_repeats(spark):
    rows = [(i, 5) for i in range(500)] + [(9, 5)] * 200 + [(None, 5), (1, 8), (2, -3)]
    found = importance.ranked(spark.createDataFrame(rows, "id long, score long").repartition(6), percent=90).collect()
    order = sorted(rows, key=lambda r: (-r[1], r[0] is not None, r[0] or 0))
    n = len(rows) * 90 // 100
    assert sorted((r.rank, r.id, r.score) for r in found if r["rank"]) == [(k + 1, *r) for k, r in enumerate(order[:n])]
    assert len(found) == len(rows)


def test_resampling_edges(spark):
    none, target = documents(spark, []), spark.createDataFrame([("a b",)], "text string")
    assert importance.resample(none, target).count() == 0
    rows = [(None, "a b c"), (1, None), (1, None), (2, "a b c"), (2, "a b c")]
    found = importance.resample(documents(spark, rows), target.limit(0), 100, 0).collect()
    assert sorted(r["rank"] for r in found) == [1, 2, 3, 4, 5]
    assert [r.weight for r in found if r.n_words == 0] == [0, 0]
