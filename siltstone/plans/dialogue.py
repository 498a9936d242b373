"""Text rules, grounding, conversations, sampling and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import nested, numbers, text
from siltstone.operators import chunking, classify, evidence, ground, sampling
from siltstone.plans import analysis
from siltstone.plans.base import Plans
from siltstone.sources.files import shape_works, table
from siltstone.streaming import events as streams

plans = Plans()

_PRIORITY = {"tool": ["bolt", "gear"], "colour": ["red", "blue", "green"], "size": ["small", "large", "big"]}


def _has(col: str, keys: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower({col}), '{k}')" for k in keys) + ")"


@plans.add("select p_partkey, case " + " ".join(f"when {_has('p_name', k)} then '{n}'" for n, k in _PRIORITY.items()) + " else 'other' end as class, "
    + " + ".join(f"cast({_has('p_name', k)} as int)" for k in _PRIORITY.values()) + " > 1 as multi, not (" + " or ".join(_has("p_name", k) for k in _PRIORITY.values()) + ") as by_default from part")
def classify_priority(spark, d):
    """Classes by keywords in order of priority, with a mark for several and for none."""
    found, multi, none = classify.by_priority(F.col("p_name"), _PRIORITY, list(_PRIORITY), "other")
    return table(spark, d, "part").select("p_partkey", found.alias("class"), multi.alias("multi"), none.alias("by_default"))


@plans.add("select p_name, count(*) as n from part where not (" + " or ".join(_has("p_name", k) for k in _PRIORITY.values()) + ") group by 1")
def default_names(spark, d):
    """Names that no rule covers, by how often they occur."""
    _, _, none = classify.by_priority(F.col("p_name"), _PRIORITY, list(_PRIORITY), "other")
    return table(spark, d, "part").filter(none).groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))


#: Character references as pages have them, with and without a semicolon.
_UNESCAPE = "x"
for _e, _c in {"&lt;?": "<", "&gt;?": ">", "&quot;?": '"', "&#39;?": "'", "&apos;": "'", "&nbsp;?": "\u00a0", "&copy;?": "©", "&middot;?": "·", "&#8211;?": "–", "&amp;?": "&"}.items():
    _UNESCAPE = "regexp_replace(" + _UNESCAPE + f", '{_e}', '{_c.replace(chr(39), chr(39) * 2)}', 'g')"
_CLEAN = f"regexp_replace({_UNESCAPE}, '<[^>]*>', ' ', 'g')"


@plans.add(f"""with a as (select page_id, html as x from pages), b as (select page_id, {_CLEAN} as x from a), c as (select page_id, {_CLEAN} as x from b)
select page_id, nullif(trim(regexp_replace(x, '\\s+', ' ', 'g')), '') as text from c""")
def html_clean(spark, d):
    return table(spark, d, "pages").select("page_id", text.clean_html(F.col("html")).alias("text"))


@plans.add(r"""select page_id, trim(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '_')[1:120] as slug, cast(nullif(regexp_extract(html, '\b((?:19|20)\d\d)\b', 1), '') as int) as year,
  nullif(rtrim(regexp_extract(html, 'https?://\S+', 0), '.,);'), '') as link,
  case when len(url) > 22 then url[1:20] || '…' else url end as short from pages""")
def page_fields(spark, d):
    """Slug, year, link and short form of each page."""
    url, page = F.col("url"), F.col("html")
    return table(spark, d, "pages").select("page_id", text.slug(url).alias("slug"), text.year_of(page).alias("year"), text.url_of(page).alias("link"), text.ellipsis(url).alias("short"))


@plans.add(r"""select doc_id, array_to_string(w[1:12], ' ') || case when len(w) > 12 then '…' else '' end as title, md5(trim(regexp_replace(regexp_replace(lower(replace(text, '-', ' ')), '[/|,;:]+', ' ', 'g'), '\s+', ' ', 'g'))) as norm
  from (select doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from documents)""")
def document_titles(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", text.title_of(F.col("text")).alias("title"), F.md5(text.norm_match(F.col("text"))).alias("norm"))


@plans.add(r"""select doc_id, md5(regexp_replace(text, '(\w)-\n(\w)', '\1\2', 'g')) as joined, ceil(len(text) / 24.0) as n_pieces from documents""")
def dehyphenate(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(text.dehyphenate(F.col("text"))).alias("joined"), F.size(text.pieces(F.col("text"))).cast("double").alias("n_pieces"))


_FIGURES = "<fig><p>a figure</p></fig></sec><sec><table-wrap><fig id=\"f>1\"><fig>inner</fig><p>outer</p></fig><fig>next</fig><p>table</p></table-wrap>"
_JATS = (f"'<article><front><title>Meta ' || source || '</title></front><abstract><p>In &#8211; ' || lang || '</p></abstract><body><sec><title>1 Text</title><p>' || replace(text, chr(10), '</p><p>') || ' <xref>[1]</xref></p>"
    f"{_FIGURES}</sec></body><back><ref-list>back</ref-list></back></article>'")


@plans.add(f"""with x as (select doc_id, replace({_JATS}, '{_FIGURES}', ' </sec><sec> ') as x from documents), k as (select doc_id, array_to_string(regexp_extract_all(x, '(?s)<(?:abstract|body)>.*?</(?:abstract|body)>'), chr(10) || chr(10)) as x from x),
d as (select doc_id, regexp_replace(regexp_replace(x, '<xref>.*?</xref>', ' ', 'g'), '</(?:p|sec|title|abstract)>', chr(10) || chr(10), 'g') as x from k),
t as (select doc_id, regexp_replace({_UNESCAPE.replace("regexp_replace(x,", "regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'),", 1)}, '[ \\t]+', ' ', 'g') as x from d),
s as (select doc_id, regexp_replace(x, '^\\s+|\\s+$', '', 'g') as x from t)
select doc_id, md5(x) as digest, len(list_filter(regexp_split_to_array(x, '\\n{{2,}}'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g') <> '')) as n_paragraphs from s""")
def jats_clean(spark, d):
    """Documents as article XML, their text without front matter, nested figures and references, and its paragraphs."""
    xml = F.expr(_JATS.replace("chr(10)", "char(10)"))
    body = text.clean_jats(xml)
    return table(spark, d, "documents").select("doc_id", F.md5(body).alias("digest"), F.size(text.paragraphs(body)).cast("long").alias("n_paragraphs"))


@plans.add(r"""with w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') as w from documents)
select doc_id, md5(array_to_string(w, ' ')) as digest from w where len(w) > 0""")
def inverted_index_text(spark, d):
    """Texts put together again from their inverted index (word and positions)."""
    index = chunking.inverted(table(spark, d, "documents"), "doc_id", text.words(F.col("text"))).filter(F.size("postings") > 0)
    return index.select("doc_id", F.md5(text.inverted_to_text(F.col("postings"))).alias("digest"))


_VARIANTS = "[v, abs(v), round_even(v, 0), round_even(v, 1), round_even(v, 2), round_even(abs(v), 0)]"


@plans.add(f"select l_orderkey, l_linenumber, round(list_sum(list_distinct({_VARIANTS})), 4) as total, len(list_distinct({_VARIANTS})) as n from (select l_orderkey, l_linenumber, ln(l_extendedprice) * 1000 - 10500 as v from lineitem)")
def number_variants(spark, d):
    """The forms in which a number may be stated."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numbers.variants(F.log("l_extendedprice") * 1000 - 10500).alias("f"))
    return rows.select("l_orderkey", "l_linenumber", F.round(F.aggregate("f", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("f").cast("long").alias("n"))


_NUMS = r"regexp_extract_all({0}, '\d+(?:\.\d+)?')"
_FORMS = "list_distinct(flatten(list_transform({0}, lambda t: [cast(t as double), abs(cast(t as double)), round_even(cast(t as double), 0), round_even(cast(t as double), 1), round_even(cast(t as double), 2)])))"
_PAIRED = r"paired as (select doc_id, text, coalesce(html, '') as html from documents left join pages on doc_id = page_id)"


@plans.add(rf"""with {_PAIRED}, t as (select doc_id, {_NUMS.format(r"regexp_replace(text, '\[G?\d+\]', ' ', 'g')")} as toks, {_FORMS.format(_NUMS.format('html'))} as allowed from paired)
select doc_id, len(toks) as n_numbers, len(list_filter(toks, lambda k: not ((cast(k as double) = floor(cast(k as double)) and cast(k as double) between 0 and 10)
  or list_has_any([cast(k as double), round_even(cast(k as double), 0), round_even(cast(k as double), 1), round_even(cast(k as double), 2)], allowed)))) as n_ungrounded from t""")
def number_guardrail(spark, d):
    """Numbers of a document that its page of the same id does not state."""
    docs = table(spark, d, "documents").join(table(spark, d, "pages"), F.col("doc_id") == F.col("page_id"), "left")
    docs = docs.select("doc_id", "text", ground.allowed_numbers(F.coalesce("html", F.lit(""))).alias("allowed"))
    return docs.select("doc_id", F.size(numbers.tokens(F.col("text"))).cast("long").alias("n_numbers"), F.size(ground.ungrounded(F.col("text"), F.col("allowed"))).cast("long").alias("n_ungrounded"))


_TREE = r"""select j.id, cast(unnest(case when type in ('UBIGINT', 'BIGINT', 'DOUBLE') then [atom] when type = 'VARCHAR' then regexp_extract_all(atom, '\d+(?:\.\d+)?') else [] end
    || case when key is not null and fullkey not like '%]' then regexp_extract_all(key, '\d+(?:\.\d+)?') else [] end) as double) as v from j, json_tree(j.j)"""


@plans.add(rf"""with l as (select l_orderkey, list(struct_pack(l_linenumber := l_linenumber, "2nd" := struct_pack(price := -l_extendedprice, late := l_discount > 0.05, note := l_returnflag || ' 7.25 v' || l_suppkey)) order by l_linenumber) as lines from lineitem group by 1),
j as (select l_orderkey as id, to_json(struct_pack(lines := lines, total99 := null, cut := [[1.5, len(lines)], [2500]])) as j from l), v as (select distinct id, v from ({_TREE}))
select id as l_orderkey, count(*) as n, round(sum(v), 2) as total, max(v) as highest from v group by 1""")
def nested_numbers(spark, d):
    """The different numbers of each order as a nested record: values, strings and names at every depth."""
    line = F.struct("l_linenumber", F.struct((-F.col("l_extendedprice")).alias("price"), (F.col("l_discount") > 0.05).alias("late"), F.concat("l_returnflag", F.lit(" 7.25 v"), F.col("l_suppkey").cast("string")).alias("note")).alias("2nd"))
    orders = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    cut = F.array(F.array(F.lit(1.5), F.size("lines").cast("double")), F.array(F.lit(2500.0)))
    found = nested.record_numbers(F.struct("lines", F.lit(None).cast("double").alias("total99"), cut.alias("cut")))
    orders = orders.select("l_orderkey", found.alias("v"))
    return orders.select("l_orderkey", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 2).alias("total"), F.array_max("v").alias("highest"))


_ASKED = f"""with {analysis._RANKED}, lines as (select *, practice || ': ~' || cast(cast(round_even(abs(pct_change), 0) as bigint) as varchar) || '% ' || case when direction > 0 then 'increase' else 'reduce' end || ' in ' || indicator as effect from ranked),
j as (select family || '/' || indicator as id, to_json(struct_pack(family := family, indicator := indicator, recommendations := list(effect order by rank) filter (rank <= 3),
  details := struct_pack(n_candidates := count(*), n_grounded := count(*) filter (n_evidence > 0), ranked := list(struct_pack(rank := rank, practice := practice, pct_change := pct_change, log_ratio := log_ratio, n_evidence := n_evidence, effect := effect))))) as j from lines group by family, indicator),
v as (select distinct id, unnest([v, abs(v), round_even(v, 0), round_even(v, 1), round_even(v, 2), round_even(abs(v), 0)]) as v from ({_TREE}))"""


@plans.add(rf"""{_ASKED}, a as (select id, list(v) as allowed from v group by 1), ids as (select *, row_number() over (order by id) - 1 as k, count(*) over () as m from a),
t as (select doc_id, id, allowed, regexp_extract_all(regexp_replace(text, '\[G?\d+\]', ' ', 'g'), '\d+(?:\.\d+)?') as toks from documents join ids on doc_id % m = k)
select doc_id, id, len(toks) as n_numbers, len(list_filter(toks, lambda t: not ((cast(t as double) = floor(cast(t as double)) and cast(t as double) between 0 and 10)
  or list_has_any([cast(t as double), round_even(cast(t as double), 0), round_even(cast(t as double), 1), round_even(cast(t as double), 2)], allowed)))) as n_ungrounded from t""")
def recommendation_guardrail(spark, d):
    """Numbers of documents held against a whole nested recommendation each, given in turn."""
    from pyspark.sql import Window

    found = evidence.recommend(analysis.ranked(spark, d), 3)
    record = F.struct("family", "indicator", "recommendations", "details")
    asked = found.select(F.concat_ws("/", "family", "indicator").alias("id"), ground.allowed_numbers(record=record).alias("allowed"))
    whole = Window.partitionBy(F.lit(0))  # a row for each family and indicator
    asked = asked.withColumns({"k": F.row_number().over(whole.orderBy("id")) - 1, "m": F.count(F.lit(1)).over(whole)})
    docs = table(spark, d, "documents").join(F.broadcast(asked.agg(F.max("m").alias("m"))), F.lit(True))
    met = docs.select("doc_id", "text", (F.col("doc_id") % F.col("m")).alias("k")).join(asked.drop("m"), "k")
    return met.select("doc_id", "id", F.size(numbers.tokens(F.col("text"))).cast("long").alias("n_numbers"), F.size(ground.ungrounded(F.col("text"), F.col("allowed"))).cast("long").alias("n_ungrounded"))


@plans.add("""select conv_id, source, place, n_passages, snippet from (select c.conv_id, d.source, count(*) as n_passages, arg_min(substr(d.text, 1, 240), c.turn) as snippet,
  row_number() over (partition by c.conv_id order by min(c.turn)) as place from conversations c join documents d on d.doc_id = (c.conv_id + c.turn * 3) % (select max(doc_id) + 1 from documents) group by 1, 2)""")
def citations_dedupe(spark, d):
    """One citation for each source that a conversation's passages come from, in order of the first."""
    n = table(spark, d, "documents").agg((F.max("doc_id") + 1).alias("n"))
    hits = table(spark, d, "conversations").crossJoin(F.broadcast(n)).select("conv_id", "turn", ((F.col("conv_id") + F.col("turn") * 3) % F.col("n")).alias("doc_id"))
    hits = hits.join(table(spark, d, "documents").select("doc_id", "source", F.substring("text", 1, ground.SNIPPET).alias("text")), "doc_id")
    return ground.citations(hits, "conv_id", "source", "turn", "text").select("conv_id", "source", "place", "n_passages", "snippet")


def _audited(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.array(F.lit(2024.0), F.lit(100.0)).alias("allowed"))
    return ground.audit(docs, "doc_id", "text", "allowed")


_SENTENCES = rf"""l as (select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: replace(regexp_replace(regexp_replace(x, '{text.LINE_MARK}', ''), '{text.ITEM_NUMBER}', ''), '{text.EMPHASIS}', '')), chr(10)) as x from documents),
p as (select doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(x, '([{text.SENTENCE_END}])\s+', '\1' || chr(10), 'g'), '\n+'), lambda q: trim(q, '{text.AROUND}')), lambda q: q <> '') as p from l),
s as (select doc_id, unnest(p) as sentence, generate_subscripts(p, 1) - 1 as sentence_idx from p)"""
_VALUE = "case w " + " ".join(f"when '{k}' then {float(v)!r}" for k, v in numbers.WORD_VALUES.items()) + " end"
_OPEN = "not ((v = floor(v) and v between 0 and 10) or list_has_any([v, round_even(v, 0), round_even(v, 1), round_even(v, 2)], [2024.0, 100.0]))"
_AUDIT = rf"""with {_SENTENCES}, n as (select *, list_transform(regexp_extract_all(regexp_replace(sentence, '\[G?\d+\]', ' ', 'g'), '\d+(?:\.\d+)?'), lambda t: cast(t as double)) as d,
  list_transform(list_transform(regexp_extract_all(regexp_replace(sentence, '[^\x00-\x7F]', 'x', 'g'), '{numbers.WORD_NUMBER}', 1), lambda t: lower(t)), lambda w: {_VALUE}) as w from s),
c as (select doc_id, sentence_idx, len(list_filter(d, lambda v: {_OPEN})) as n_digits, len(list_filter(w, lambda v: {_OPEN})) as n_words from n),
v as (select *, case when n_digits > 0 and n_words > 0 then 'fail_both' when n_digits > 0 then 'fail_digits' when n_words > 0 then 'fail_wordform' else 'pass' end as verdict from c)"""


@plans.add(f"{_AUDIT} select * from v")
def sentence_audit(spark, d):
    """Every sentence of every document with its numbers that are not allowed."""
    return _audited(spark, d).select("doc_id", "sentence_idx", "n_digits", "n_words", "verdict")


@plans.add(f"{_AUDIT} select verdict, count(*) as n, round_even(count(*) / sum(count(*)) over (), 3) as rate from v group by 1")
def audit_summary(spark, d):
    return ground.audit_summary(_audited(spark, d))


_CLAIM = "'About ' || (c_custkey % 40) || '% more, or twenty sites [' || (c_custkey % 4) || '] and [G' || (c_custkey % 3) || ']'"


@plans.add(f"""with c as (select c_custkey, c_custkey % 40 as pct, c_custkey % 4 as n, c_custkey % 3 as g from customer),
w as (select *, pct <= 10 or pct in (12, 25) as all_ok, n between 1 and 2 or g = 1 as cited, pct <= 10 or (pct = 12 and n = 1) or (pct = 25 and g = 1) as digit_ok, n = 2 as word_ok from c)
select c_custkey, 2 as n_numbers, case when all_ok then 'pass' else 'fail_digits' end as verdict, case when not cited then 'no_marker' when digit_ok and word_ok then 'yes' else 'no' end as cited_support from w""")
def claim_support(spark, d):
    """Claims with citation marks: whether the passages hold their numbers, and whether those that are cited do."""
    said = F.expr(_CLAIM)
    held = [F.array(F.lit("A gain of 12 percent in 2019-03."), F.lit("Twenty sites were seen.")), F.array(F.lit("It is 25 in all."))]
    found = ground.audit_claims(said, F.array().cast("array<double>"), *held)
    return table(spark, d, "customer").select("c_custkey", F.inline(F.array(found))).select("c_custkey", F.col("n_numbers").cast("int").alias("n_numbers"), "verdict", "cited_support")


@plans.add("""with p as (select conv_id, turn % 3 as practice, turn as passage from conversations where role = 'user' and turn % 3 < 2), a as (select distinct conv_id, k as practice from conversations, range(0, 3) t(k)),
own as (select conv_id, practice, passage from a join p using (conv_id, practice)), others as (select a.conv_id, a.practice, passage from a join p using (conv_id) where not exists (select 1 from p x where x.conv_id = a.conv_id and x.practice = a.practice))
select * from own union all select * from others""")
def practice_passages(spark, d):
    """Passages of each practice; one without any gets all of its request."""
    turns = table(spark, d, "conversations")
    asked = turns.select("conv_id").distinct().withColumn("practice", F.explode(F.sequence(*[F.lit(k).cast("long") for k in (0, 2)])))
    found = turns.filter("role = 'user' and turn % 3 < 2").select("conv_id", (F.col("turn") % 3).alias("practice"), F.col("turn").alias("passage"))
    return ground.passages_for(asked, found, "conv_id", "practice", "passage")


@plans.add("""select conv_id, string_agg(role || turn, ' ' order by role <> 'assistant', turn) as passages from conversations group by 1""")
def two_tiers(spark, d):
    """Passages of the first tier in order, then those of the second."""
    rows = table(spark, d, "conversations").select("conv_id", "role", "turn", F.concat("role", F.col("turn").cast("string")).alias("name"))
    out = ground.two_tiers(rows, "role", "conv_id", "assistant", "turn")
    return out.select("conv_id", F.array_join(F.transform("passages", lambda x: x["name"]), " ").alias("passages"))


@plans.add(rf"""with t as (select conv_id, turn, case when role = 'assistant' then 'r' || turn end as rec, regexp_matches(text, '{classify.FOLLOW_UP}') as f, regexp_matches(text, '{classify.ADVICE}') as a from conversations),
p as (select *, last_value(rec ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as prior from t)
select conv_id, turn, prior, case when f and prior is not null then 'explain' when a or not f then 'advise' else 'ask' end as branch from p""")
def follow_up_branch(spark, d):
    """What a turn does with the recommendation before it."""
    turns = table(spark, d, "conversations").withColumn("rec", F.when(F.col("role") == "assistant", F.concat(F.lit("r"), F.col("turn").cast("string"))))
    return classify.follow_ups(turns, "conv_id", "turn", "text", "rec").select("conv_id", "turn", "prior", "branch")


@plans.add("""with t as (select *, row_number() over (partition by lang, source, n_chars % 7 order by md5('42' || cast(doc_id as varchar)), doc_id) as turn from documents),
k as (select *, row_number() over (partition by lang, source order by turn, md5('42' || cast(doc_id as varchar)), doc_id) as pick from t)
select doc_id, lang, source, pick from k where pick <= 3""")
def quota_by_study(spark, d):
    """Three documents of each language and source, of different studies first."""
    rows = table(spark, d, "documents").withColumn("study", F.col("n_chars") % 7)
    return sampling.quota_by_study(rows, ["lang", "source"], "study", "doc_id", 3, "42").select("doc_id", "lang", "source", "pick")


@plans.add("""with k as (select *, row_number() over (partition by lang, source order by md5('42' || cast(doc_id as varchar)), doc_id) as pick from documents)
select count(*) filter (where pick <= 2) as n, count(distinct lang || '|' || source) as n_cells, count(distinct lang) as n_lang, count(distinct source) as n_source, count(*) filter (where pick > 2) as n_skipped from k""")
def build_report(spark, d):
    rows = table(spark, d, "documents")
    return sampling.build_report(rows, sampling.quota(rows, ["lang", "source"], "doc_id", 2, "42"), ["lang", "source"])


_WORK = ("'{\"DOI\": \"10.1/AB' || p_partkey || '\", \"title\": [\"' || p_name || '\"], \"published-online\": {\"date-parts\": [[' || (1990 + p_size) || ', 1]]}, \"issued\": {\"date-parts\": [[1900]]}, "
    "\"author\": [{\"given\": \"A\", \"family\": \"' || p_type || '\"}, {\"family\": \"Z\"}], \"abstract\": \"<p>On ' || p_brand || '</p>\"}'")


@plans.add("""select p_partkey, '10.1/ab' || p_partkey as doi, p_name as title, cast(null as varchar) as journal, 1990 + p_size as year, 'A ' || p_type || '; Z' as authors, 'On ' || p_brand as abstract from part""")
def paper_records(spark, d):
    """Answers of a registry of papers as flat records."""
    return shape_works(table(spark, d, "part").select("p_partkey", F.expr(_WORK).alias("answer")), "answer", "p_partkey")


@plans.add("select doc_id, len(text[1:7000]) as n_chars, md5(text[1:7000]) as digest from documents")
def embedded_text(spark, d):
    """What of each text goes into an embedding."""
    part = text.embedded(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(part).cast("long").alias("n_chars"), F.md5(part).alias("digest"))


@plans.add("select c_custkey, case when c_acctbal < 0 then 'none' when c_acctbal > 5000 then 'model' else 'template' end as source, c_acctbal >= 0 as grounded from customer")
def explain_decision(spark, d):
    balance = F.col("c_acctbal")
    found = ground.explain(balance >= 0, F.when(balance > 1000, F.lit("text")), balance > 5000, F.lit("fallback"))
    return table(spark, d, "customer").select("c_custkey", found["source"].alias("source"), found["grounded"].alias("grounded"))


@plans.add("select c_custkey, era as key from (select c_custkey, coalesce(nullif(trim(case when c_custkey % 2 = 0 then c_name else ' ' end), ''), nullif(trim(case when c_custkey % 3 = 0 then c_mktsegment end), ''), 'chunk-' || c_custkey) as era from customer)")
def identity_keys(spark, d):
    key, none = F.col("c_custkey"), F.lit(None).cast("string")
    found = ground.identity(F.when(key % 2 == 0, F.col("c_name")).otherwise(" "), F.when(key % 3 == 0, F.col("c_mktsegment")), none, none, key)
    return table(spark, d, "customer").select("c_custkey", found.alias("key"))


_SLOT = "case when contains(lower(text), 'keit') then 'german' when contains(lower(text), 'avec') then 'french' when contains(lower(text), 'with') then 'english' end"


def _slot():
    low = F.lower("text")
    has = lambda w: F.contains(low, F.lit(w))
    return F.when(has("keit"), "german").when(has("avec"), "french").when(has("with"), "english")


@plans.add(f"select conv_id, turn, last_value(s ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as slot from (select conv_id, turn, case when role = 'user' then {_SLOT} end as s from conversations)")
def slot_carry_forward(spark, d):
    """The slot that each turn knows of: the latest that a user has stated so far."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", _slot()).alias("slot"))
    return classify.carry_forward(turns, "conv_id", "turn", ["slot"])


@plans.add("select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations) where n <= 20")
def history_cap(spark, d):
    return classify.last_turns(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role")


@plans.add(r"""select conv_id, turn, regexp_matches(text, '(?i)\b(why|explain|how\s+sure|evidence|confidence|detail|because|how\s+(?:do|to|can)|implement|apply|steps|alternativ|other\s+option|instead|compare|better|else)\b') as follow_up,
  regexp_matches(text, '(?i)\b(recommend|suggest|what\s+(?:should|can)\s+i|help\s+me|want\s+to|need\s+to|how\s+(?:do|can)\s+i|reduce|increase|improve|practice|erosion|yield|soil|runoff|income|fodder)\b')
  or not regexp_matches(text, '(?i)\b(why|explain|how\s+sure|evidence|confidence|detail|because|how\s+(?:do|to|can)|implement|apply|steps|alternativ|other\s+option|instead|compare|better|else)\b') as advice from conversations""")
def intent_flags(spark, d):
    follow, advice = classify.intents(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", follow.alias("follow_up"), advice.alias("advice"))


def _messages(spark, d):
    key = F.col("c_custkey")
    crop = F.when(key % 3 == 0, "Teff").when(key % 3 == 1, "wheat and maize").otherwise("grass")
    at = lambda x: (F.floor(x) / 100).cast("string")
    said = F.concat(F.lit("my farm is at "), at(F.col("c_acctbal") / 5), F.lit(", "), at(F.col("c_acctbal") / 2 + 2000), F.lit(" and I grow "), crop)
    return table(spark, d, "customer").select("c_custkey", said.alias("text"))


@plans.add(r"""with m as (select c_custkey, c_acctbal, c_custkey % 3 as k, floor(c_acctbal / 5) / 100 as lat, floor(c_acctbal / 2 + 2000) / 100 as lon from customer)
select c_custkey, case when lat between 3.3 and 14.9 and lon between 32.9 and 48.2 then lat end as lat, case when lat between 3.3 and 14.9 and lon between 32.9 and 48.2 then lon end as lon,
  case k when 0 then 'Teff' when 1 then 'Maize' end as crop from m""")
def coordinates_and_crops(spark, d):
    """Coordinates and crops stated in messages; the crop listed first wins."""
    at = classify.coordinates(F.col("text"))
    return _messages(spark, d).select("c_custkey", at["lat"].alias("lat"), at["lon"].alias("lon"), classify.first_word(F.col("text"), classify.CROPS).alias("crop"))


_PHRASES = [("red widget", "red"), ("widget", "any"), ("blue", "blue"), ("small ring", "ring"), ("ring", "ring")]


@plans.add("""select p_partkey, key, case when n >= 8 then 'high' else 'medium' end as confidence from (select p_partkey, unnest([
  case when contains(p_name, 'red widget') then {'n': 10, 'i': 0, 'key': 'red'} end, case when contains(p_name, 'widget') then {'n': 6, 'i': -1, 'key': 'any'} end,
  case when contains(p_name, 'blue') then {'n': 4, 'i': -2, 'key': 'blue'} end, case when contains(p_name, 'small ring') then {'n': 10, 'i': -3, 'key': 'ring'} end,
  case when contains(p_name, 'ring') then {'n': 4, 'i': -4, 'key': 'ring'} end], recursive := true) from part)
  where key is not null qualify row_number() over (partition by p_partkey order by n desc, i desc) = 1""")
def longest_phrases(spark, d):
    found = classify.longest_phrase(F.col("p_name"), _PHRASES)
    return table(spark, d, "part").select("p_partkey", found.alias("f")).filter("f is not null").select("p_partkey", "f.key", "f.confidence")


_SOFT = {"colour": ("red", "blue", "green"), "form": ("ring", "bolt", "gear")}


@plans.add("""with n as (select p_partkey, p_name, cast(contains(p_name, 'red') as int) + cast(contains(p_name, 'blue') as int) + cast(contains(p_name, 'green') as int) as c,
  cast(contains(p_name, 'ring') as int) + cast(contains(p_name, 'bolt') as int) + cast(contains(p_name, 'gear') as int) as f from part)
select p_partkey, case when contains(p_name, 'widget') then 'colour' when greatest(c, f) >= 2 or greatest(c, f) = 1 and least(c, f) = 0 then case when c >= f then 'colour' else 'form' end end as family,
  case when contains(p_name, 'widget') then 'high' when greatest(c, f) >= 2 then 'medium' when greatest(c, f) = 1 and least(c, f) = 0 then 'low' end as confidence from n""")
def soft_families(spark, d):
    found = classify.family(F.col("p_name"), [("widget", "colour")], _SOFT)
    return table(spark, d, "part").select("p_partkey", found["family"].alias("family"), found["confidence"].alias("confidence"))


@plans.add("""with g as (select row_number() over (order by n_nationkey) as pos, lower(substr(n_name, 1, 3)) as alias, n_name as place from nation),
t as (select doc_id, trim(regexp_replace(regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) as t from documents)
select doc_id, alias, place from t join g on contains(t, alias) qualify row_number() over (partition by doc_id order by len(alias) desc, pos) = 1""")
def gazetteer_longest(spark, d):
    """The longest place alias that stands in a text, wherever in a word."""
    from pyspark.sql import Window

    names = table(spark, d, "nation").select(F.row_number().over(Window.orderBy("n_nationkey")).alias("pos"), F.lower(F.substring("n_name", 1, 3)).alias("alias"), F.col("n_name").alias("place"))
    return classify.gazetteer(table(spark, d, "documents"), "doc_id", "text", names)


@plans.add(r"""with a as (select doc_id, regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '(?i)\b(?:in|near|at|around|from)\s+([A-Za-z][A-Za-z'' ]+)', 1) as a from documents),
b as (select doc_id, list_filter(list_transform(a, lambda x: trim(regexp_split_to_array(x, '(?i)\b(?:and|with|for|to|on|where|because|but|my|the)\b')[1])), lambda x: len(x) >= 3) as b from a)
select doc_id, array_to_string(list_sort(list_distinct(b)), '|') as places from b""")
def place_candidates(spark, d):
    """Phrases of each document that may name a place, sorted; letters beyond ASCII end a phrase."""
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "_")
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(classify.place_candidates(plain)), "|").alias("places"))


@plans.add("select doc_id, lang, source, pick from (select *, row_number() over (partition by lang, source order by md5('42' || cast(doc_id as varchar)), doc_id) as pick from documents) where pick <= 2")
def stratified_quota(spark, d):
    """Two documents of each language and source, in md5 order."""
    return sampling.quota(table(spark, d, "documents"), ["lang", "source"], "doc_id", 2, "42").select("doc_id", "lang", "source", "pick")


@plans.add("""select doc_id, lang, round from (select doc_id, lang, source, row_number() over (partition by lang, source order by doc_id) as round from documents) order by round, lang, source limit 50""")
def round_robin(spark, d):
    """Fifty documents that take one of each cell in turn."""
    return sampling.round_robin(table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 50).select("doc_id", "lang", "round")


_DIGIT = "strpos('0123456789abcdef', substr(md5('7' || cast(conv_id as varchar)), 1, 1)) - 1"


@plans.add(f"""with c as (select distinct conv_id from conversations), p as (select conv_id, substr(md5('7:code:' || cast(conv_id as varchar)), 1, 8) as item_code, ({_DIGIT}) % 2 as odd from c)
select conv_id, item_code, 'X' as label, case odd when 0 then 'with' else 'without' end as condition from p union all select conv_id, item_code, 'Y', case odd when 0 then 'without' else 'with' end from p""")
def blinded_packets(spark, d):
    return sampling.packets(table(spark, d, "conversations").select("conv_id").distinct(), "conv_id", ("with", "without"), "7")


@plans.add(f"""with c as (select distinct conv_id from conversations), p as (select conv_id, substr(md5('7:code:' || cast(conv_id as varchar)), 1, 8) as item_code, ({_DIGIT}) % 2 as odd from c),
k as (select item_code, 'X' as label, case odd when 0 then 'with' else 'without' end as condition from p union all select item_code, 'Y', case odd when 0 then 'without' else 'with' end from p)
select condition, label, count(*) as n from k group by 1, 2""")
def unblinding(spark, d):
    """Packets joined with their key by item code and label."""
    key = sampling.packets(table(spark, d, "conversations").select("conv_id").distinct(), "conv_id", ("with", "without"), "7")
    shown = key.select("item_code", "label")
    return shown.join(key.select("item_code", "label", "condition"), ["item_code", "label"]).groupBy("condition", "label").agg(F.count(F.lit(1)).alias("n"))


@plans.add("""with recursive e as (select user_id, event_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as n from events),
r as (select user_id, event_id, n, true as allowed, [t] as kept from e where n = 1
  union all select e.user_id, e.event_id, e.n, len(list_filter(r.kept, lambda k: k > e.t - 86400000000)) < 3,
    case when len(list_filter(r.kept, lambda k: k > e.t - 86400000000)) < 3 then list_append(list_filter(r.kept, lambda k: k > e.t - 86400000000), e.t)
    else list_filter(r.kept, lambda k: k > e.t - 86400000000) end from r join e on e.user_id = r.user_id and e.n = r.n + 1)
select user_id, event_id, allowed from r""")
def rate_limit(spark, d):
    """Three events a day for each user; those refused do not count."""
    return streams.rate_limit(table(spark, d, "events"), "user_id", "event_id", "ts", 86400, 3)


def _chat(spark, d):
    turns = table(spark, d, "conversations")
    advice = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("r"), F.col("turn").cast("string")))
    return streams.chat_events(turns, ["conv_id", "turn"], F.col("role"), advice, text.pieces(F.col("text")))


@plans.add("""with n as (select conv_id, turn, role, text, cast(ceil(len(text) / 24.0) as bigint) as p, turn % 2 as r from conversations)
select conv_id, turn, 0 as seq, 'slots' as event, role as data from n union all select conv_id, turn, 1, 'recommendation', 'r' || turn from n where r = 1
union all select conv_id, turn, i + 1 + r, 'token', substr(text, cast(i * 24 + 1 as bigint), 24) from (select *, unnest(range(0, p)) as i from n)
union all select conv_id, turn, p + 1 + r, 'done', '' from n""")
def chat_events(spark, d):
    """Each turn as an ordered stream of events."""
    return _chat(spark, d)


@plans.add("""select conv_id, turn, text, role as slots, case when turn % 2 = 1 then 'r' || turn end as recommendation, cast(null as varchar) as error from conversations""")
def event_fold(spark, d):
    """Event streams put together again, one row a turn."""
    return streams.fold(_chat(spark, d), ["conv_id", "turn"])


@plans.add("""with n as (select conv_id, turn, text, len(regexp_replace(text, '\\s', '', 'g')) as k from conversations)
select 'token' as event, count(*) as n from n where k > 0 union all select 'message', count(*) from n where k > 0""")
def sse_parse(spark, d):
    """Server-sent events parsed from text: blocks between blank lines, those without data skipped."""
    flat = F.regexp_replace("text", r"\s", "")
    lines = F.concat(F.lit("event: token\ndata: "), flat, F.lit("\n\ndata: "), flat, F.lit("\n\nnoise"))
    return streams.parse_sse(table(spark, d, "conversations").select(lines.alias("t")), "t").groupBy("event").agg(F.count(F.lit(1)).alias("n"))


@plans.add("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def tumbling(spark, d):
    return streams.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"], "value")


@plans.add("""select s as start, event_type, count(*) as n from (select event_type, ts, unnest([time_bucket(interval 30 minute, ts), time_bucket(interval 30 minute, ts) - interval 30 minute]) as s from events) group by 1, 2""")
def sliding(spark, d):
    return streams.sliding(table(spark, d, "events"), "ts", "1 hour", "30 minutes", ["event_type"])


@plans.add("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hour then 0 else 1 end as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, k""")
def sessions(spark, d):
    return streams.sessions(table(spark, d, "events"), "ts", "2 hours", "user_id")


@plans.add("select conv_id, max(turn) as turn, arg_max(text, turn) as text from conversations where role = 'user' group by 1")
def latest_user_turn(spark, d):
    return streams.latest_user_turn(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
