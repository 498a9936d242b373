"""Retrieval over many queries at once: postings and BM25, exact cosine, rank fusion, hybrid lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import words
from siltstone.session import settled

#: BM25's usual parameters; the share of the mean idf that replaces negative ones; candidates of each list; the fusion constant.
K1, B, EPSILON, CANDIDATES, FUSION = 1.5, 0.75, 0.25, 40, 60

#: Weights of query terms that are sent to all tasks at most; scores of queries and texts in memory at once.
MOST_ASKED, _SCORES = 200_000, 1 << 22
#: Words of the documents in a block of an index.
BLOCK_WORDS = 1 << 20


def _tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))


def build_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """An inverted index by blocks of documents: every text is cut into words once.

    A row is a block: ids and dl (words) of its documents; its terms, and for each the end of its postings, its
    greatest tf and the least dl it stands in; postings as doc (a place in ids) and tf.  Write it as a table to keep it.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def block(ids: list[pa.Array], held: list[pa.Array]) -> pa.RecordBatch:
        words_ = pa.concat_arrays(held)
        length = pc.fill_null(pc.list_value_length(words_), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words_.flatten().dictionary_encode()
        terms = coded.dictionary
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        key, tf = np.unique(code * max(len(length), 1) + np.repeat(np.arange(len(length)), length), return_counts=True)
        term, doc = np.divmod(key, max(len(length), 1))
        first = np.searchsorted(term, np.arange(len(terms)))
        most, least = (np.maximum.reduceat(tf, first), np.minimum.reduceat(length[doc], first)) if len(terms) else (tf, tf)
        one = lambda x, t: pa.array([x], pa.list_(t))
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(length)], pa.int32()), pa.concat_arrays(ids)), one(length, pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms.cast(pa.string())), one(np.searchsorted(term, np.arange(len(terms)), "right"), pa.int32()),
             one(most, pa.int32()), one(least, pa.int32()), one(doc, pa.int32()), one(tf, pa.int32())],
            ["ids", "dl", "terms", "ends", "most", "least", "doc", "tf"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size = [], [], 0
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("w")), 0).to_numpy(zero_copy_only=False))
            a = 0
            while a < batch.num_rows:
                before = int(ends[a - 1]) if a else 0
                b = min(batch.num_rows, max(a + 1, int(np.searchsorted(ends, before + BLOCK_WORDS - size, "right"))))
                ids.append(batch.column("id").slice(a, b - a))
                held.append(batch.column("w").slice(a, b - a))
                size, a = size + int(ends[b - 1]) - before, b
                if size >= BLOCK_WORDS:
                    yield block(ids, held)
                    ids, held, size = [], [], 0
        if ids:
            yield block(ids, held)

    schema = f"ids array<{kind}>, dl array<int>, terms array<string>, ends array<int>, most array<int>, least array<int>, doc array<int>, tf array<int>"
    return _tokens(docs, id_col, text_col).mapInArrow(run, schema)


def index_stats(index: DataFrame) -> DataFrame:
    """n_docs, avgdl: one row."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    sums = index.select(F.size("ids").cast("long").alias("n"), total("dl").alias("w")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"), F.sum("w").alias("w"))
    return sums.select("n_docs", (F.col("w") / F.nullif("n_docs", F.lit(0))).alias("avgdl"))


def document_counts(index: DataFrame) -> DataFrame:
    """term, df: in how many documents each term stands; a row for each term and block is all that moves."""
    counts = F.zip_with("ends", F.concat(F.array(F.lit(0)), "ends"), lambda end, before: end - before)
    return index.select(F.explode(F.arrays_zip("terms", F.slice(counts, 1, F.size("ends")).alias("n"))).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.n").alias("df"))


def postings(index: DataFrame) -> DataFrame:
    """id, term, tf, dl: the index's postings one by one."""
    spans = F.zip_with(F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0)))), "ends", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    terms = index.select("ids", "dl", "doc", "tf", F.explode(F.arrays_zip("terms", spans.alias("s"))).alias("x"))
    size = F.col("x.s.b") - F.col("x.s.a")
    own = terms.select("ids", "dl", F.col("x.terms").alias("term"), F.arrays_zip(F.slice("doc", F.col("x.s.a") + 1, size).alias("doc"), F.slice("tf", F.col("x.s.a") + 1, size).alias("tf")).alias("p"))
    return own.select("term", "ids", "dl", F.inline("p")).select(F.get("ids", "doc").alias("id"), "term", "tf", F.get("dl", "doc").alias("dl"))


def term_weights(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf of document counts; negative idf becomes EPSILON times the mean idf over all terms."""
    raw = counts.crossJoin(F.broadcast(stats.select("n_docs"))).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))


def bm25(queries: DataFrame, docs: DataFrame, query_id: str, query_text: str, doc_id: str, doc_text: str, k: int = CANDIDATES) -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents with a positive score; ties by id.

    The index is built once and settled; search() reads it.
    """
    return search(queries, settled(build_index(docs, doc_id, doc_text)), query_id, query_text, "doc_id", k)


def search(queries: DataFrame, index: DataFrame, query_id: str, query_text: str, doc_id: str = "doc_id", k: int = CANDIDATES) -> DataFrame:
    """query_id, doc_id, score, rank of an index that is there.

    A query's repeated terms count as often as they stand.  Up to MOST_ASKED weights of query terms go to all tasks, which
    score the index's blocks where they are and shuffle their k best only; a query passes over a block whose terms
    cannot lift any document above its k-th best so far.  More weights meet postings in a join.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(words(F.col(query_text))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    stats = index_stats(index)
    weighted = asked.join(term_weights(document_counts(index), stats), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    some = weighted.limit(MOST_ASKED + 1).toArrow()
    if some.num_rows <= MOST_ASKED:
        schema = f"query_id {queries.schema[query_id].dataType.simpleString()}, doc_id {index.schema['ids'].dataType.elementType.simpleString()}, score double"
        shared = index.sparkSession.sparkContext.broadcast((some, stats.first()["avgdl"] or 1.0))
        total = index.mapInArrow(_score_blocks(shared, k), schema)
        return top(total, "query_id", F.col("score").desc(), "doc_id", k).withColumn("score", F.round("score", 6)).withColumnRenamed("doc_id", doc_id)
    posted = postings(index).crossJoin(F.broadcast(stats.select("avgdl")))
    one = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = posted.join(weighted, "term").withColumn("part", one)
    total = scored.groupBy("query_id", F.col("id").alias("doc_id")).agg(F.round(F.sum("part"), 6).alias("score")).filter("score > 0")
    return top(total, "query_id", F.col("score").desc(), "doc_id", k).withColumnRenamed("doc_id", doc_id)


def _score_blocks(shared, k: int):
    """Blocks of an index to the k best documents of a task for each query; shared: (query_id, term, weight) and avgdl."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, avgdl = shared.value
        names, query = np.unique(asked.column("query_id").to_numpy(zero_copy_only=False), return_inverse=True)
        terms, term = np.unique(asked.column("term").to_numpy(zero_copy_only=False), return_inverse=True)
        order = np.argsort(term, kind="stable")
        query, weight, first = query[order], asked.column("weight").to_numpy()[order], np.searchsorted(term[order], np.arange(len(terms) + 1))
        lookup = pa.array(terms, pa.string())
        part = lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
        best: list[tuple] = [(np.zeros(0, object), np.zeros(0))] * len(names)
        floor, kind = np.zeros(len(names)), pa.string()
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for i in range(batch.num_rows):
                field = lambda n: batch.column(n)[i].values  # noqa: B023, E731
                ids, dl = field("ids").to_numpy(zero_copy_only=False), field("dl").to_numpy()
                at = pc.fill_null(pc.index_in(field("terms"), value_set=lookup), -1).to_numpy(zero_copy_only=False)
                there = np.flatnonzero(at >= 0)
                ends, doc, tf = field("ends").to_numpy(), field("doc").to_numpy(), field("tf").to_numpy()
                bound = np.zeros(len(names))
                highest = part(field("most").to_numpy()[there], field("least").to_numpy()[there])
                for t, high in zip(at[there].tolist(), highest.tolist(), strict=True):
                    own = slice(first[t], first[t + 1])
                    bound[query[own]] += np.maximum(weight[own], 0) * high
                wanted = np.flatnonzero(np.round(bound, 6) > floor - 1e-6)
                row = np.full(len(names), -1)
                for a in range(0, len(wanted), step := max(1, _SCORES // max(len(ids), 1))):
                    here = wanted[a : a + step]
                    row[:] = -1
                    row[here] = np.arange(len(here))
                    out = np.zeros((len(here), len(ids)))
                    for t, j in zip(at[there].tolist(), there.tolist(), strict=True):
                        own = slice(first[t], first[t + 1])
                        to = row[query[own]]
                        if (to >= 0).any():
                            p = slice(int(ends[j - 1]) if j else 0, int(ends[j]))
                            out[to[to >= 0, None], doc[p]] += weight[own][to >= 0, None] * part(tf[p], dl[doc[p]])
                    _merge(best, floor, here, np.round(out, 6), ids, k)
        size = [len(x[0]) for x in best]
        if sum(size):
            columns = [pa.array(np.repeat(names, size), asked.column("query_id").type), pa.array(np.concatenate([x[0] for x in best]), kind), pa.array(np.concatenate([x[1] for x in best]))]
            yield pa.record_batch(columns, names=["query_id", "doc_id", "score"])

    return run


def _merge(best: list[tuple], floor: np.ndarray, here: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
    """Take the block's documents into the k best of the queries `here`; floor is a query's k-th best score so far."""
    if scores.shape[1] > k:  # all that may be among the k best of a row, ties included
        least = np.partition(scores, -k, axis=1)[:, -k]
    else:
        least = np.zeros(len(here))
    for q, row, low in zip(here.tolist(), scores, least.tolist(), strict=True):
        hit = np.flatnonzero((row > 0) & (row >= max(low, floor[q])))
        if not len(hit):
            continue
        every, score = np.r_[best[q][0], ids[hit].astype(object)], np.r_[best[q][1], row[hit]]
        if len(every) > k:
            near = np.argsort(every, kind="stable")
            near = near[np.argsort(-score[near], kind="stable")][:k]
            every, score = every[near], score[near]
        best[q] = every, score
        if len(every) == k:
            floor[q] = score.min()


def top(scored: DataFrame, group: str, order: Column, tie: str, k: int) -> DataFrame:
    """Add rank and keep the first k of each group."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order, tie))).filter(F.col("rank") <= k)


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    rows = flat.reshape(table.num_rows, -1)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _best_of_block(k: int):
    """The k best of a block of vectors for each query of a block of queries."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if asked.num_rows and held.num_rows:
            ids = held.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, scores = ids[order], np.round(_matrix(asked) @ _matrix(held)[order].T, 6)
            for query, row in zip(asked.column("id").to_pylist(), scores, strict=True):
                others = np.flatnonzero(ids != query)
                best = others[np.argsort(-row[others], kind="stable")[:k]]
                out = [[*out[0], np.full(len(best), query)], [*out[1], ids[best]], [*out[2], row[best]]]
        columns = [np.concatenate([np.zeros(0, t), *x]) for x, t in zip(out, (np.int64, np.int64, np.float64), strict=True)]
        return pa.Table.from_arrays([pa.array(c) for c in columns], names=["query_id", "doc_id", "score"])

    return run


def cosine(queries: DataFrame, vectors: DataFrame, id_col: str, vec_col: str, k: int = CANDIDATES, size: int = 4096, asked: int = 1024) -> DataFrame:
    """query_id, doc_id, score, rank: the k vectors of highest cosine for each query, others than itself; ties by id.

    The stated queries meet all vectors in blocks, of about `asked` queries and `size` vectors: each pair of blocks keeps
    its k best, so what is ranked at last is bounded by queries, blocks and k.  Vectors that are null, empty, zero or
    hold null components have no direction and take no part; only vectors of one dimension meet.
    """
    def usable(df):
        v = F.col(vec_col).cast("array<double>")
        return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull()))

    def number(n):
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    here, there = usable(vectors), usable(queries)
    many, few = (-(-df.count() // most) or 1 for df, most in ((here, size), (there, asked)))
    here = here.withColumn("dim", F.size("v")).withColumn("block", number(many)).withColumn("part", every(few))
    there = there.withColumn("dim", F.size("v")).withColumn("part", number(few)).withColumn("block", every(many))
    keys = ("dim", "block", "part")
    met = there.groupBy(*keys).cogroup(here.groupBy(*keys)).applyInArrow(_best_of_block(k), "query_id long, doc_id long, score double")
    return top(met, "query_id", F.col("score").desc(), "doc_id", k).withColumn("score", F.round("score", 6))


def fuse(dense: DataFrame, lexical: DataFrame, k: int, constant: int = FUSION) -> DataFrame:
    """query_id, doc_id, score, rank by the sum of 1 / (constant + rank); ties by dense rank, absent last, then lexical."""
    both = dense.select("query_id", "doc_id", F.col("rank").alias("dense"), F.lit(None).cast("int").alias("lexical"))
    both = both.unionByName(lexical.select("query_id", "doc_id", F.lit(None).cast("int").alias("dense"), F.col("rank").alias("lexical")))
    merged = both.groupBy("query_id", "doc_id").agg(F.max("dense").alias("dense"), F.max("lexical").alias("lexical"))
    part = lambda c: F.coalesce(1.0 / (F.lit(constant) + F.col(c)), F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(F.desc("raw"), F.asc_nulls_last("dense"), F.asc_nulls_last("lexical"))
    ranked = merged.withColumn("raw", F.round(part("dense") + part("lexical"), 12)).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "doc_id", F.round("raw", 8).alias("score"), "rank")


def with_chunks(hits: DataFrame, chunks: DataFrame, id_col: str) -> DataFrame:
    """Ranked hits with what is known of them; ids that are not known fall away after the cut."""
    return hits.join(chunks, hits["doc_id"] == chunks[id_col]).drop(chunks[id_col])


def by_practice(hits: DataFrame, practices: int, k: int) -> DataFrame:
    """Hits (practice_rank, rank, doc_id, practice) of one request's practices: a quota for each, then distinct, then k.

    request, doc_id, practice, place.
    """
    each = max(2, k // max(practices, 1))
    some = hits.filter(F.col("rank") <= each)
    first = Window.partitionBy("request", "doc_id").orderBy("practice_rank", "rank")
    once = some.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("request").orderBy("practice_rank", "rank")))
    return placed.filter(F.col("place") <= k).select("request", "doc_id", "practice", "place")
