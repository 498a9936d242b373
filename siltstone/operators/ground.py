"""Grounding: citations, allowed numbers, the numeric guardrail, audits of sentences, explanation decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.nested import record_numbers
from siltstone.functions.numbers import NUMBER, all_variants, grounded, tokens, variants, word_tokens, word_value
from siltstone.functions.text import sentences

SNIPPET = 240


def identity(era: Column, url: Column, doi: Column, title: Column, pos: Column) -> Column:
    """What makes two passages one source: the first of code, URL, DOI and title that is there, else the passage itself."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in (era, url, doi, title)], F.concat(F.lit("chunk-"), pos.cast("string")))


def citations(hits: DataFrame, request: str, key: str, pos: str, text: str) -> DataFrame:
    """request, key, place, n_passages, snippet: one citation a source, in order of its first passage."""
    first = hits.groupBy(request, key).agg(F.min(pos).alias("first"), F.count(F.lit(1)).alias("n_passages"), F.min_by(F.substring(text, 1, SNIPPET), pos).alias("snippet"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(request).orderBy("first"))).drop("first")


def allowed_numbers(*texts: Column, values: Column | None = None, record: Column | None = None) -> Column:
    """All forms of the numbers in texts, where a hyphen is no sign, of an array of numbers, which keep theirs, and of a
    nested record, harvested whole: values, strings and names at every depth.  The result is to be selected as a column
    before it is compared, since no Python function runs within a lambda.

    An address is none of the texts: its digits never stand in what is quoted.
    """
    written = all_variants(F.regexp_extract_all(F.concat_ws(" ", *texts), F.lit(f"({NUMBER})"), 1))
    more = [values, record_numbers(record) if record is not None else None]
    return reduce(F.array_union, [written, *[all_variants(F.coalesce(m, F.array().cast("array<double>"))) for m in more if m is not None]])


def all_grounded(text: Column, allowed: Column) -> Column:
    return F.forall(tokens(text), lambda t: grounded(t, allowed))


def ungrounded(text: Column, allowed: Column) -> Column:
    return F.filter(tokens(text), lambda t: ~grounded(t, allowed))


def ungrounded_words(text: Column, allowed: Column, quoted: Column | None = None) -> Column:
    """Number words beyond the free ones that the quoted text does not have and whose value, in any form, is not allowed."""
    held = F.lit(False) if quoted is None else None

    def ok(w):
        value = word_value(w)
        there = held if held is not None else F.array_contains(word_tokens(quoted), w)
        return there | ((value == F.floor(value)) & value.between(0, 10)) | F.arrays_overlap(variants(value), allowed)

    return F.filter(word_tokens(text), lambda w: ~ok(w))


def verdict(text: Column, allowed: Column, quoted: Column | None = None) -> Column:
    return _verdict(F.size(ungrounded(text, allowed)) > 0, F.size(ungrounded_words(text, allowed, quoted)) > 0)


def _verdict(digits: Column, named: Column) -> Column:
    return F.when(digits & named, "fail_both").when(digits, "fail_digits").when(named, "fail_wordform").otherwise("pass")


def audit(texts: DataFrame, id_col: str, text_col: str, allowed: str) -> DataFrame:
    """id_col, sentence_idx, sentence, n_digits, n_words, verdict of every sentence."""
    rows = texts.select(id_col, allowed, F.posexplode(sentences(F.col(text_col))).alias("sentence_idx", "sentence"))
    bad, badw = F.size(ungrounded(F.col("sentence"), F.col(allowed))), F.size(ungrounded_words(F.col("sentence"), F.col(allowed)))
    counted = rows.select(id_col, F.col("sentence_idx").cast("long").alias("sentence_idx"), "sentence", bad.cast("long").alias("n_digits"), badw.cast("long").alias("n_words"))
    return counted.withColumn("verdict", _verdict(F.col("n_digits") > 0, F.col("n_words") > 0))


def audit_claims(sentence: Column, base: Column, evidence: Column, guidance: Column) -> Column:
    """struct<n_numbers, verdict, cited_support> of a sentence with numbers; null of one without.

    base: allowed numbers that every claim may state; evidence and guidance: arrays of passage texts that [n] and [Gn]
    name, from 1.  The verdict is by all passages; support is by those that the sentence cites: yes, no, or no_marker
    where it cites none that there is.
    """
    marks = lambda pattern: F.transform(F.regexp_extract_all(sentence, F.lit(pattern), 1), lambda m: m.try_cast("int"))
    valid = lambda ns, held: F.transform(F.filter(ns, lambda n: n.between(1, F.size(held))), lambda n: F.get(held, n - 1))
    cited = F.concat(valid(marks(r"\[(\d+)\]"), evidence), valid(marks(r"\[G(\d+)\]"), guidance))
    quoted, every = F.lower(F.array_join(cited, " ")), F.lower(F.array_join(F.concat(evidence, guidance), " "))
    whole, some = (F.array_union(base, allowed_numbers(t)) for t in (every, quoted))
    support = F.when(F.size(cited) == 0, "no_marker").when(verdict(sentence, some, quoted) == "pass", "yes").otherwise("no")
    n = F.size(tokens(sentence)) + F.size(word_tokens(sentence))
    return F.when(n > 0, F.struct(n.cast("long").alias("n_numbers"), verdict(sentence, whole, every).alias("verdict"), support.alias("cited_support")))


def audit_summary(audited: DataFrame) -> DataFrame:
    """verdict, n, rate (3 places)."""
    counted = audited.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("rate", F.bround(F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy(F.lit(0)))), 3))


def passages_for(practices: DataFrame, passages: DataFrame, request: str, practice: str, pool: str) -> DataFrame:
    """Each request's practices with the passages found for them; a practice without any gets the request's whole pool."""
    own = practices.join(passages.withColumnRenamed(pool, "_pool"), [request, practice])
    without = practices.join(passages.select(request, practice).distinct(), [request, practice], "left_anti")
    others = without.join(passages.drop(practice).withColumnRenamed(pool, "_pool").dropDuplicates([request, "_pool"]), request)
    return own.unionByName(others).withColumnRenamed("_pool", pool)


def two_tiers(passages: DataFrame, tier: str, request: str, evidence: str, order: str) -> DataFrame:
    """request, passages: the evidence tier's in order, then the other tier's, each ranked within its own tier."""
    line = F.struct((F.col(tier) != evidence).alias("_second"), F.col(order).alias("_place"), *[c for c in passages.columns if c not in (request, order)])
    held = passages.groupBy(request).agg(F.array_sort(F.collect_list(line)).alias("_all"))
    return held.select(request, F.transform("_all", lambda x: x.dropFields("_second", "_place")).alias("passages"))


def explain(has_chunks: Column, llm_text: Column, llm_grounded: Column, fallback: Column) -> Column:
    """struct<text, source, grounded>: nothing to cite: ungrounded; model text that is grounded; else the template."""
    made = llm_text.isNotNull() & F.coalesce(llm_grounded, F.lit(False))
    return (
        F.when(~has_chunks, F.struct(fallback.alias("text"), F.lit("none").alias("source"), F.lit(False).alias("grounded")))
        .when(made, F.struct(llm_text.alias("text"), F.lit("model").alias("source"), F.lit(True).alias("grounded")))
        .otherwise(F.struct(fallback.alias("text"), F.lit("template").alias("source"), F.lit(True).alias("grounded")))
    )
