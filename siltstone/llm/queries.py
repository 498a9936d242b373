"""The registered queries opN_* over the driver's tables; each derives its digest columns from its operator's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.substring_dedup import remove_repeated_windows

    found = remove_repeated_windows(_table(spark, sf_dir, "documents"), "doc_id", "text", 13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("clean_text").cast("binary"), 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"), "doc_id", "text", words=4, seed=42, bits=4)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.topk import top_products

    return top_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10, 1024)


def op9_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.collision_ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op5_byte_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    import public_tokenizers

    from siltstone.llm.bpe import encode, read_ranks

    ranks = read_ranks(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    both = encode(_table(spark, sf_dir, "documents"), ranks, pattern or public_tokenizers.PATTERN, "doc_id", "text", decoded=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.common import shared_path
    from siltstone.llm.warc import read_archives, write_archives

    path = shared_path(spark, "warc")
    write_archives(_table(spark, sf_dir, "pages"), path, min_bytes=1000)
    return read_archives(spark, path, payloads=False).drop("payload", "url")


#: Sites, of about twenty sources, from which a line counts as boilerplate.
MIN_SITES = 10


def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.line_spread import remove_spread_lines

    found = remove_spread_lines(_table(spark, sf_dir, "documents"), MIN_SITES)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("clean_text").cast("binary"), 256).alias("kept_sha256"))


#: Domains are the residues of a source's number; weights by level; the share of all tokens asked for; epochs allowed.
DOMAINS, WEIGHTS, SHARE, EPOCHS, SEED = 3, {"domain": {"domain0": 3, "domain1": 2, "domain2": 1}, "lang": {"en": 3, "*": 2}, "source": {"src0": 2, "*": 1}}, 0.8, 2, 13


def domain_of_source():
    """The domain of a source: its number's residue, or 'other'."""
    number = F.regexp_extract("source", "([0-9]+)$", 1)
    return F.when(number == "", "other").otherwise(F.concat(F.lit("domain"), F.pmod(F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint)"), F.lit(DOMAINS))))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.mixing import mix

    budget = F.floor(F.col("tokens") * round(SHARE * 100) / 100)
    found = mix(_table(spark, sf_dir, "documents"), domain_of_source(), WEIGHTS, budget, EPOCHS, SEED)
    return found.select("doc_id", "domain", "lang", "source", "n_tokens", "epochs", "partial")


def op1_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.page_diff import extract

    found = extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def held_out(id_col):
    """Rows that no label is learnt from."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.toxicity import score, train

    docs = _table(spark, sf_dir, "documents")
    model = train(docs, _table(spark, sf_dir, "labels"), ~held_out(F.col("id")))
    found = score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: What a leaf of the manifest holds, in order.
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.merkle import fold, leaf_digest, manifest, proof_digest

    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False)) & (F.instr("text", "\n") > 0)
    tampered = F.when(changed, F.unhex(leaf_digest(*LEAF[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit("")))))
    found = manifest(_table(spark, sf_dir, "documents"), LEAF, carry={"tampered": tampered})
    folded = fold(F.coalesce(F.lower(F.hex("tampered")), "leaf"), "proof")
    found = found.select("doc_id", "leaf", "subroot", "root", proof_digest("proof").alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Hosts, paths with which a URL's path must start, and verdicts.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.url_filter import judge

    return judge(_table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.importance import resample

    found = resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=10, least_words=20, seed=2024, buckets=10_000, runs=1)
    return found.select("doc_id", "n_features", "weight", "score", "rank")
