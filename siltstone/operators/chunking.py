"""Chunks of texts: windows of words, greedy packing of paragraphs, the best chunks of a document."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import cased_words, occurrences, words

SIZE, STEP, CARRY = 380, 320, 60
#: Words indexed at a time.
INDEXED = 1 << 18


def inverted(df: DataFrame, id_col: str, words: Column) -> DataFrame:
    """id_col, postings (array of (word, positions)): each row's own inverted index, made where the row is; nothing is shuffled."""

    def index(some: pa.RecordBatch, size: np.ndarray) -> pa.RecordBatch:
        coded = some.column("w").flatten().dictionary_encode()
        many = max(len(coded.dictionary), 1)
        key = np.repeat(np.arange(len(size)), size) * many + coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(key, kind="stable")
        key, place = key[order], (np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size))[order]
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        row, word = np.divmod(key[begin], many)
        positions = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(key)], pa.int32()), pa.array(place, pa.int32()))
        entries = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(word)), positions], ["word", "positions"])
        ends = np.cumsum(np.bincount(row, minlength=len(size)))
        return pa.RecordBatch.from_arrays([some.column("id"), pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), entries)], ["id", "postings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch.column("w")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, a = np.cumsum(size), 0
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + INDEXED, "right")))
                yield index(batch.slice(a, b - a), size[a:b])
                a = b

    kind = df.schema[id_col].dataType.simpleString()
    found = df.select(F.col(id_col).alias("id"), words.alias("w")).mapInArrow(run, f"id {kind}, postings array<struct<word:string,positions:array<int>>>")
    return found.withColumnRenamed("id", id_col)


def windows(df: DataFrame, id_col: str, text_col: str, size: int = SIZE, step: int = STEP) -> DataFrame:
    """id_col, pos, n_words, chunk: overlapping windows of words as they are written; the last may be short."""
    rows = df.select(id_col, cased_words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.ceil((F.size("w") - size) / step), F.lit(0)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i * step + 1, F.lit(size)))
    return rows.select(id_col, F.posexplode(parts).alias("pos", "c")).select(id_col, F.col("pos").cast("long").alias("pos"), F.size("c").cast("long").alias("n_words"), F.array_join("c", " ").alias("chunk"))


def greedy(df: DataFrame, id_col: str, paragraphs: Column, size: int = SIZE, carry: int = CARRY) -> DataFrame:
    """id_col, pos, n_words, chunk: paragraphs packed into chunks of at most `size` words.

    A chunk is closed before the paragraph that would overfill it, and the next begins with its last `carry` words.  A
    longer paragraph closes the chunk too and is cut into windows of its own, after which nothing is carried.  A
    remainder of at most `carry` words is dropped, unless there is nothing else.  A chunk is a range of the text's words,
    so only the ends of ranges are carried along and words are cut out once.
    """
    rows = df.select(id_col, F.transform(paragraphs, cased_words).alias("ps"))
    rows = rows.select(id_col, F.flatten("ps").alias("w"), F.filter(F.transform("ps", F.size), lambda n: n > 0).alias("sizes")).filter(F.size("w") > 0)
    spans = F.array().cast("array<struct<a:int,b:int>>")
    empty = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), spans.alias("done"))
    step = size - carry
    one = lambda a, b: F.array(F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")))

    def pack(s, n):
        a, b, done = s["a"], s["b"], s["done"]
        closed = F.when(b > a, F.concat(done, one(a, b))).otherwise(done)
        starts = F.sequence(F.lit(0), F.ceil((n - size) / step).cast("int"))
        cut = F.transform(starts, lambda i: F.struct((b + i * step).cast("int").alias("a"), F.least(b + i * step + size, b + n).cast("int").alias("b")))
        over = (b > a) & (b - a + n > size)
        start = F.when(n > size, b + n).when(over, F.greatest(a, b - carry)).otherwise(a)
        out = F.when(n > size, F.concat(closed, cut)).when(over, closed).otherwise(done)
        return F.struct(start.cast("int").alias("a"), (b + n).cast("int").alias("b"), out.alias("done"))

    packed = rows.select(id_col, "w", F.aggregate("sizes", empty, pack).alias("s"))
    keep = (F.col("s.b") - F.col("s.a") > carry) | (F.size("s.done") == 0)
    spans = F.when(keep, F.concat("s.done", one(F.col("s.a"), F.col("s.b")))).otherwise(F.col("s.done"))
    out = packed.select(id_col, "w", F.posexplode(spans).alias("pos", "c")).select(id_col, "pos", F.slice("w", F.col("c.a") + 1, F.col("c.b") - F.col("c.a")).alias("c"))
    return out.select(id_col, F.col("pos").cast("long").alias("pos"), F.size("c").cast("long").alias("n_words"), F.array_join("c", " ").alias("chunk"))


def keyword_stats(text: Column, keywords: list[str]) -> tuple[Column, Column]:
    """Keywords that stand in a text, and how often they do in all."""
    counts = F.array(*[occurrences(text, k) for k in keywords])
    return F.size(F.filter(counts, lambda n: n > 0)), F.aggregate(counts, F.lit(0), lambda a, n: a + n)


def best_chunks(chunks: DataFrame, id_col: str, keywords: list[str], most: int) -> DataFrame:
    """Chunks with a keyword, at most `most` of each document (0: all): most different ones, most hits, first in place."""
    distinct, hits = keyword_stats(F.lower("chunk"), keywords)
    scored = chunks.withColumn("kw_distinct", distinct.cast("long")).withColumn("kw_hits", hits.cast("long")).filter("kw_distinct > 0")
    order = Window.partitionBy(id_col).orderBy(F.desc("kw_distinct"), F.desc("kw_hits"), F.asc("pos"))
    return scored if most == 0 else scored.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def with_ids(chunks: DataFrame, id_col: str, prefix: str = "") -> DataFrame:
    """Add chunk_id: prefix, document, and place in three digits."""
    place = F.row_number().over(Window.partitionBy(id_col).orderBy("pos")) - 1
    return chunks.withColumn("chunk_id", F.concat(F.lit(prefix), F.col(id_col).cast("string"), F.lit("_"), F.lpad(place.cast("string"), 3, "0")))


def best_source(df: DataFrame, sources: list[str], floor: int, exempt: set[str]) -> DataFrame:
    """Add text_source and body: the first source with enough words; exempt ones need one word only."""
    n = {s: F.size(words(F.coalesce(F.col(s), F.lit("")))) for s in sources}
    ok = {s: n[s] >= (1 if s in exempt else floor) for s in sources}
    name = F.coalesce(*[F.when(ok[s], F.lit(s)) for s in sources])
    body = F.coalesce(*[F.when(ok[s], F.col(s)) for s in sources])
    return df.withColumn("text_source", name).withColumn("body", body)


def relevant_families(title: Column, text: Column, rules: Mapping[str, list[str]]) -> Column:
    """Families of which the title has a keyword or the text two different ones."""
    def holds(keys):
        return (keyword_stats(F.lower(title), keys)[0] >= 1) | (keyword_stats(F.lower(text), keys)[0] >= 2)

    return F.array_compact(F.array(*[F.when(holds(keys), F.lit(name)) for name, keys in rules.items()]))


def country_rule(meta: Column, title: Column, text: Column, name: str, least: int = 3) -> Column:
    """How a record belongs to a country: by metadata if it says anything, else by title, else by enough mentions."""
    low = name.lower()
    return (
        F.when(F.trim(F.coalesce(meta, F.lit(""))) != "", F.when(F.contains(F.lower(meta), F.lit(low)), "metadata"))
        .when(F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit(low)), "title")
        .when(occurrences(F.lower(text), low) >= least, "text")
    )
