"""Retrieval, evaluation and chunks over documents, embeddings and benchmark passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators import chunking, evaluate, retrieval
from siltstone.plans.base import Plans
from siltstone.session import settled
from siltstone.sources.files import table

plans = Plans()

_TOKENS = r"list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda w: w <> '')"
_BM25 = rf"""toks as (select doc_id, {_TOKENS.format('text')} as w from documents),
posted as (select doc_id, term, count(*) as tf, any_value(dl) as dl from (select doc_id, len(w) as dl, unnest(w) as term from toks) group by 1, 2),
stats as (select count(*) as n_docs, avg(len(w)) as avgdl from toks),
raw as (select term, count(*) as df, ln(any_value(n_docs) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from posted, stats group by 1),
idf as (select term, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw),
asked as (select item_id as query_id, term, count(*) as qtf from (select item_id, unnest({_TOKENS.format('text')}) as term from benchmark) group by 1, 2),
total as (select query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
  from asked join idf using (term) join posted using (term), stats group by 1, 2),
lexical as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from total where score > 0) where rank <= 40)"""

_COSINE = """u as (select vec_id, list_transform(cast(embedding as double[]), lambda x: x / sqrt(list_sum(list_transform(cast(embedding as double[]), lambda y: y * y)))) as v from embeddings),
met as (select q.vec_id as query_id, d.vec_id as doc_id, round(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])), 6) as score from u q join u d on q.vec_id <> d.vec_id where q.vec_id % 50 = 0),
dense as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from met) where rank <= 40)"""


def lexical(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "text", "doc_id", "text")


def dense(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    return retrieval.cosine(vectors.filter("vec_id % 50 = 0"), vectors, "vec_id", "embedding")


@plans.add(rf"select doc_id, len(w) as n_tokens, len(list_distinct(w)) as n_distinct from (select doc_id, {_TOKENS.format('text')} as w from documents)")
def tokenize(spark, d):
    from siltstone.functions.text import words

    rows = table(spark, d, "documents").select("doc_id", words(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@plans.add(rf"""with toks as (select doc_id, list_distinct({_TOKENS.format('text')}) as w from documents),
df as (select term, count(*) as df from (select unnest(w) as term from toks) group by 1),
raw as materialized (select term, df, ln((select count(*) from documents) - df + 0.5) - ln(df + 0.5) as raw from df),
mean as materialized (select avg(raw) as m from raw)
select term, df, round(case when raw < 0 then 0.25 * m else raw end, 6) as idf from raw, mean""")
def term_weights(spark, d):
    """Every term with the documents it stands in and its weight."""
    index = settled(retrieval.build_index(table(spark, d, "documents"), "doc_id", "text"))
    found = retrieval.term_weights(retrieval.document_counts(index), retrieval.index_stats(index))
    return found.select("term", "df", F.round("idf", 6).alias("idf"))


@plans.add(f"with {_BM25} select query_id, doc_id, score, rank from lexical")
def bm25_topk(spark, d):
    """The 40 best documents for every benchmark passage."""
    return lexical(spark, d)


@plans.add(f"with {_COSINE} select query_id, doc_id, rank from dense")
def cosine_topk(spark, d):
    """The 40 vectors of highest cosine for each query vector."""
    return dense(spark, d).select("query_id", "doc_id", "rank")


_FUSED = """parts as (select query_id, doc_id, rank as dense, null as lexical from {0} union all select query_id, doc_id, null, rank from {1}),
merged as (select query_id, doc_id, max(dense) as dense, max(lexical) as lexical from parts group by 1, 2),
fused as (select *, row_number() over (partition by query_id order by raw desc, dense nulls last, lexical nulls last) as rank
  from (select *, round(coalesce(1.0 / (60 + dense), 0) + coalesce(1.0 / (60 + lexical), 0), 12) as raw from merged))"""

# The lexical list of vector q: documents by their closeness in length to document q, as a second opinion on the same ids.
_SECOND = """second as (select * from (select e.vec_id as query_id, o.vec_id as doc_id,
  row_number() over (partition by e.vec_id order by abs(e.label - o.label), o.vec_id) as rank from embeddings e join embeddings o on e.label = o.label and e.vec_id <> o.vec_id where e.vec_id % 50 = 0) where rank <= 40)"""


def second(spark, d):
    """Vectors of a query's own label, by id: another ranked list over the same ids."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    place = F.dense_rank().over(Window.partitionBy("label").orderBy("doc_id"))  # a query's own id aside, 40 are left of the first 41
    first = e.withColumnRenamed("vec_id", "doc_id").withColumn("place", place).filter("place <= 41").drop("place")
    met = q.join(first, "label").filter("query_id <> doc_id")
    return retrieval.top(met.select("query_id", "doc_id"), "query_id", F.lit(0).asc(), "doc_id", 40)


@plans.add(f"with {_COSINE}, {_SECOND}, {_FUSED.format('dense', 'second')} select query_id, doc_id, round(raw, 8) as score, rank from fused where rank <= 20")
def rrf_fuse(spark, d):
    """Two ranked lists over vectors, fused by reciprocal ranks."""
    return retrieval.fuse(dense(spark, d), second(spark, d), 20)


@plans.add(f"""with {_BM25}, {_COSINE}, lex as (select query_id * 50 as query_id, doc_id, rank from lexical), {_FUSED.format('dense', 'lex')},
cut as (select query_id, doc_id, rank from fused where rank <= 20) select query_id, cut.doc_id, rank, source from cut join documents on cut.doc_id = documents.doc_id""")
def hybrid_topk(spark, d):
    """Dense and lexical lists of paired queries, fused, cut, and looked up; unknown ids fall away after the cut."""
    fused = retrieval.fuse(dense(spark, d), lexical(spark, d).withColumn("query_id", F.col("query_id") * 50), 20)
    return retrieval.with_chunks(fused, table(spark, d, "documents").select(F.col("doc_id").alias("known"), "source"), "known").select("query_id", "doc_id", "rank", "source")


@plans.add(f"""with {_BM25}, hits as (select query_id // 4 as request, query_id % 4 as practice_rank, 'p' || (query_id % 4) as practice, doc_id, rank from lexical where rank <= 4),
once as (select *, row_number() over (partition by request, doc_id order by practice_rank, rank) as n from hits),
placed as (select *, row_number() over (partition by request order by practice_rank, rank) as place from once where n = 1)
select request, doc_id, practice, place from placed where place <= 16""")
def practice_retrieval(spark, d):
    """Each request's practices with a quota each, distinct documents, and one cut."""
    hits = lexical(spark, d).select(F.expr("query_id div 4").alias("request"), (F.col("query_id") % 4).alias("practice_rank"), F.concat(F.lit("p"), (F.col("query_id") % 4).cast("string")).alias("practice"), "doc_id", "rank")
    return retrieval.by_practice(hits, 4, 16)


_SCORED = f"""{_COSINE}, ranked as (select query_id, 's' || (e.vec_id % 97) as study, rank from dense join embeddings e on e.vec_id = doc_id),
relevant as (select distinct q.vec_id as query_id, 's' || (e.vec_id % 97) as study from embeddings q join embeddings e on q.label = e.label and q.vec_id <> e.vec_id where q.vec_id % 50 = 0),
firsts as (select query_id, study, min(rank) as rank from ranked group by 1, 2), hits as (select * from firsts join relevant using (query_id, study)),
found as (select query_id, min(rank) as first, count(*) filter (where rank <= 4) as h4, count(*) filter (where rank <= 8) as h8, count(*) filter (where rank <= 16) as h16 from hits group by 1),
sizes as (select query_id, count(*) as n from relevant group by 1), ids as (select query_id from ranked union select query_id from relevant),
scored as (select query_id, round(coalesce(h4 / nullif(n, 0), 0), 6) as recall_4, round(coalesce(h8 / nullif(n, 0), 0), 6) as recall_8, round(coalesce(h16 / nullif(n, 0), 0), 6) as recall_16,
  coalesce(cast(h4 > 0 as int), 0) as success_4, coalesce(cast(h8 > 0 as int), 0) as success_8, coalesce(cast(h16 > 0 as int), 0) as success_16, round(coalesce(1 / first, 0), 6) as mrr
  from ids left join sizes using (query_id) left join found using (query_id))"""


def _labelled(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    study = lambda c: F.concat(F.lit("s"), (F.col(c) % 97).cast("string"))
    ranked = dense(spark, d).select("query_id", study("doc_id").alias("study"), "rank")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    relevant = q.join(e, "label").filter("query_id <> vec_id").select("query_id", study("vec_id").alias("study"))
    return ranked, relevant


def _scored(spark, d):
    return evaluate.score(*_labelled(spark, d))


@plans.add(f"with {_SCORED} select * from scored")
def success_recall_mrr(spark, d):
    return _scored(spark, d)


@plans.add(f"""with {_SCORED}, g as (select *, case when query_id % 100 = 0 then 'even' else 'odd' end as family, 'i' || (query_id % 3) as indicator from scored)
select case when grouping(family) = 0 then 'family' when grouping(indicator) = 0 then 'indicator' else 'all' end as scope,
  coalesce(case when grouping(family) = 0 then family end, case when grouping(indicator) = 0 then indicator end, 'all') as name, count(*) as n,
  round_even(avg(recall_4), 4) as recall_4, round_even(avg(success_8), 4) as success_8, round_even(avg(mrr), 4) as mrr from g group by grouping sets ((), (family), (indicator))""")
def retrieval_report(spark, d):
    """Mean quality over all queries and over two groupings, in one pass."""
    rows = _scored(spark, d).withColumn("family", F.when(F.col("query_id") % 100 == 0, "even").otherwise("odd")).withColumn("indicator", F.concat(F.lit("i"), (F.col("query_id") % 3).cast("string")))
    return evaluate.report(rows, ["family", "indicator"], ["recall_4", "success_8", "mrr"])


@plans.add(f"""with {_SCORED}, wide as (select distinct q.vec_id as query_id, 's' || (e.vec_id % 97) as study from embeddings q join embeddings e on q.label % 5 = e.label % 5 and q.vec_id <> e.vec_id where q.vec_id % 100 = 0
  union all select query_id, study from relevant where query_id % 100 <> 0), whits as (select * from firsts join wide using (query_id, study)),
wfound as (select query_id, min(rank) as first, count(*) filter (where rank <= 8) as h8 from whits group by 1), wsizes as (select query_id, count(*) as n from wide group by 1)
select query_id, recall_8, mrr, round(coalesce(h8 / nullif(n, 0), 0), 6) as family_recall_8, round(coalesce(1 / first, 0), 6) as family_mrr from scored left join wsizes using (query_id) left join wfound using (query_id)""")
def family_levels(spark, d):
    """Quality by strict and by family labels; queries without family labels keep their strict ones."""
    ranked, relevant = _labelled(spark, d)
    e = table(spark, d, "embeddings").select("vec_id", "label")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), (F.col("label") % 5).alias("k"))
    wide = q.join(e.withColumn("k", F.col("label") % 5), "k").filter("query_id <> vec_id").select("query_id", F.concat(F.lit("s"), (F.col("vec_id") % 97).cast("string")).alias("study"))
    return evaluate.score_levels(ranked, relevant, wide).select("query_id", "recall_8", "mrr", "family_recall_8", "family_mrr")


@plans.add("select s.doc_id, substr(study, 5) as study from (select doc_id, 'ERA_' || source as study from documents) s where substr(study, 5) in (select 'src' || (label * 2) from embeddings)")
def silver_labels(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("ERA_"), F.col("source")).alias("era"))
    corpus = table(spark, d, "embeddings").select(F.concat(F.lit("src"), (F.col("label") * 2).cast("string")).alias("study"))
    return evaluate.silver_labels(rows, corpus, "era").select("doc_id", "study")


_WORDS = r"w as (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') as w from documents)"


@plans.add(rf"""with {_WORDS}, p as (select doc_id, w, unnest(range(0, cast(greatest(ceil((len(w) - 380) / 320.0), 0) as bigint) + 1)) as pos from w where len(w) > 0)
select doc_id, pos, len(w[pos * 320 + 1 : pos * 320 + 380]) as n_words, md5(array_to_string(w[pos * 320 + 1 : pos * 320 + 380], ' ')) as digest from p""")
def chunk_windows(spark, d):
    """Overlapping word windows of every document, as written."""
    return chunking.windows(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "pos", "n_words", F.md5("chunk").alias("digest"))


_CASED = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"


@plans.add(rf"""with recursive p as (select doc_id, n, {_CASED.format('x')} as w from (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as n from documents)),
q as (select doc_id, w, row_number() over (partition by doc_id order by n) as n, cast(sum(len(w)) over (partition by doc_id order by n) as bigint) as b from p where len(w) > 0),
f as (select doc_id, cast(0 as bigint) as n, cast(0 as bigint) as a, cast(0 as bigint) as b, false as shut, cast(0 as bigint) as x, cast(0 as bigint) as y from (select distinct doc_id from q)
  union all select f.doc_id, q.n, case when len(q.w) > 380 then q.b when f.b > f.a and f.b - f.a + len(q.w) > 380 then greatest(f.a, f.b - 60) else f.a end, q.b,
    f.b > f.a and (len(q.w) > 380 or f.b - f.a + len(q.w) > 380), f.a, f.b from f join q on f.doc_id = q.doc_id and q.n = f.n + 1),
c as (select doc_id, n, 0 as i, x, y from f where shut
  union all select doc_id, n, i + 1, b - len(w) + i * 320, least(b - len(w) + i * 320 + 380, b) from (select *, unnest(range(0, cast(ceil((len(w) - 380) / 320.0) as bigint) + 1)) as i from q where len(w) > 380)),
ends as (select doc_id, max_by(n, n) as n, max_by(a, n) as a, max_by(b, n) as b from f group by 1),
every as (select * from c union all select doc_id, n + 1, 0, a, b from ends where b - a > 60 or (b > a and not exists (select 1 from c where c.doc_id = ends.doc_id))),
words as (select doc_id, flatten(list(w order by n)) as w from q group by 1)
select doc_id, row_number() over (partition by doc_id order by n, i) - 1 as pos, y - x as n_words, md5(array_to_string(w[x + 1 : y], ' ')) as digest from every join words using (doc_id)""")
def chunk_greedy(spark, d):
    """Paragraphs packed greedily, each chunk beginning with the end of the one before."""
    found = chunking.greedy(table(spark, d, "documents"), "doc_id", F.split("text", "\n"))
    return found.select("doc_id", "pos", "n_words", F.md5("chunk").alias("digest"))


_KEYS = ["the", "tion", "keit"]


@plans.add(rf"""with {_WORDS}, p as (select doc_id, w, unnest(range(0, cast(greatest(ceil((len(w) - 380) / 320.0), 0) as bigint) + 1)) as pos from w where len(w) > 0),
c as (select doc_id, pos, array_to_string(w[pos * 320 + 1 : pos * 320 + 380], ' ') as chunk from p),
k as (select *, (len(chunk) - len(replace(chunk, 'the', ''))) // 3 as a, (len(chunk) - len(replace(chunk, 'tion', ''))) // 4 as b, (len(chunk) - len(replace(chunk, 'keit', ''))) // 4 as e from (select doc_id, pos, lower(chunk) as chunk from c)),
s as (select doc_id, pos, cast(a > 0 as int) + cast(b > 0 as int) + cast(e > 0 as int) as kw_distinct, a + b + e as kw_hits from k)
select doc_id, pos, kw_distinct, kw_hits, doc_id || '_' || lpad(cast(row_number() over (partition by doc_id order by pos) - 1 as varchar), 3, '0') as chunk_id from
  (select *, row_number() over (partition by doc_id order by kw_distinct desc, kw_hits desc, pos) as n from s where kw_distinct > 0) where n <= 3""")
def chunk_topk_per_doc(spark, d):
    """Each document's three best chunks by keywords, numbered in order of place."""
    best = chunking.best_chunks(chunking.windows(table(spark, d, "documents"), "doc_id", "text"), "doc_id", _KEYS, 3)
    return chunking.with_ids(best, "doc_id").select("doc_id", "pos", "kw_distinct", "kw_hits", "chunk_id")


_RULES = {"english": ["with", "this", "from"], "german": ["nicht", "sich", "für"], "french": ["avec", "pour", "dans"]}


def _rule_sql() -> str:
    def has(col, keys):
        return " + ".join(f"cast(contains(lower({col}), '{k}') as int)" for k in keys)

    return " || ".join(f"case when {has('title', k)} >= 1 or {has('text', k)} >= 2 then '{n} ' else '' end" for n, k in _RULES.items())


@plans.add(f"select doc_id, trim({_rule_sql()}) as families from (select doc_id, text, string_split(text, chr(10))[1] as title from documents)")
def relevance_families(spark, d):
    """Families whose keywords the first line or the text holds."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.get(F.split("text", "\n"), F.lit(0)).alias("title"))
    return docs.select("doc_id", F.array_join(chunking.relevant_families(F.col("title"), F.col("text"), _RULES), " ").alias("families"))


@plans.add("""select how, count(*) as n from (select case when doc_id % 3 = 0 then case when contains(lower(source), 'src1') then 'metadata' end
  when contains(lower(string_split(text, chr(10))[1]), 'src1') then 'title' when (len(lower(text)) - len(replace(lower(text), 'src1', ''))) // 4 >= 3 then 'text' end as how from documents) group by 1""")
def country_rule(spark, d):
    """How documents belong: by metadata, title, or mentions."""
    meta = F.when(F.col("doc_id") % 3 == 0, F.col("source"))
    how = chunking.country_rule(meta, F.get(F.split("text", "\n"), F.lit(0)), F.col("text"), "src1")
    return table(spark, d, "documents").select(how.alias("how")).groupBy("how").agg(F.count(F.lit(1)).alias("n"))


@plans.add(rf"""with s as (select doc_id, case when doc_id % 2 = 0 then text end as pdf, case when doc_id % 3 = 0 then text end as xml, lang as abstract from documents),
n as (select *, len({_TOKENS.format("coalesce(pdf, '')")}) as p, len({_TOKENS.format("coalesce(xml, '')")}) as x from s)
select text_source, count(*) as n, sum(len(body)) as chars from (select case when p >= 100 then 'pdf' when x >= 100 then 'xml' else 'abstract' end as text_source,
  case when p >= 100 then pdf when x >= 100 then xml else abstract end as body from n) group by 1""")
def source_precedence(spark, d):
    """The first source with enough words, the last one exempt; coverage by source."""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("pdf"), F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("xml"), F.col("lang").alias("abstract"))
    best = chunking.best_source(docs, ["pdf", "xml", "abstract"], 100, {"abstract"})
    return best.groupBy("text_source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("body").cast("long")).alias("chars"))
