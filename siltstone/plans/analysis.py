"""Preparation, quality, evidence and cross-validation over the star schema."""

from __future__ import annotations

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.numbers import confidence, log_ratio
from siltstone.operators import crossval, evidence, models, prepare, quality
from siltstone.plans.base import Plans
from siltstone.session import written
from siltstone.sources.files import new_rows, table

plans = Plans()

#: Which indicator is better when smaller.
SIGNS = {"A": 1, "N": 1, "R": -1}

_OBSERVED = """observed as (
  select r_name as family, p_brand as practice, l_returnflag as indicator, l_suppkey as study,
         ln(l_extendedprice / (l_quantity * p_retailprice)) as effect
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
  join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  where l_extendedprice > 0 and l_quantity * p_retailprice > 0)"""

_RANKED = f"""{_OBSERVED}, grouped as (
  select family, practice, indicator, count(*) as n_evidence, avg(effect) as mean from observed group by 1, 2, 3),
scored as (
  select *, round_even(mean, 4) as log_ratio, round_even((exp(mean) - 1) * 100, 1) as pct_change,
         case indicator when 'R' then -1 else 1 end as direction from grouped),
ranked as (
  select *, row_number() over (partition by family, indicator order by direction * log_ratio desc, practice) as rank from scored)"""


def observed(spark: SparkSession, d: str) -> DataFrame:
    """Lines as observations: practice, family, indicator, study, and the log ratio of price paid to list price."""
    line = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice")
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    place = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    place = place.join(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
    place = place.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name")
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(place, F.col("l_suppkey") == F.col("s_suppkey"))
    effect = log_ratio(F.col("l_extendedprice"), F.col("l_quantity") * F.col("p_retailprice"))
    out = joined.select(F.col("r_name").alias("family"), F.col("p_brand").alias("practice"), F.col("l_returnflag").alias("indicator"), F.col("l_suppkey").alias("study"), effect.alias("effect"))
    return out.filter("effect is not null")


def ranked(spark: SparkSession, d: str) -> DataFrame:
    return evidence.rank(evidence.evidence(observed(spark, d), "family", "practice", "indicator", "effect"), SIGNS)


@plans.add(f"with {_RANKED} select family, practice, indicator, n_evidence, round(mean, 6) as mean_log_ratio, log_ratio, pct_change, direction, rank from ranked")
def evidence_rank(spark, d):
    """The flagship: practices of each family ranked by direction and group-mean effect for each indicator."""
    out = ranked(spark, d).withColumn("mean_log_ratio", F.round("mean", 6))
    return out.select("family", "practice", "indicator", "n_evidence", "mean_log_ratio", "log_ratio", "pct_change", "direction", "rank")


@plans.add(f"""with {_RANKED} select family, indicator, count(*) as n_candidates, count(*) filter (where n_evidence > 0) as n_grounded,
  string_agg(practice || ': ~' || cast(cast(round_even(abs(pct_change), 0) as bigint) as varchar) || '% ' ||
    case when direction > 0 then 'increase' else 'reduce' end || ' in ' || indicator, '; ' order by rank) filter (where rank <= 3) as top
  from ranked group by family, indicator""")
def recommendation(spark, d):
    """Nested recommendations of each family and indicator, shown as one line each."""
    out = evidence.recommend(ranked(spark, d), 3)
    lines = F.transform("recommendations", lambda x: F.concat(x["practice"], F.lit(": "), x["effect"]))
    return out.select("family", "indicator", F.col("details.n_candidates").alias("n_candidates"), F.col("details.n_grounded").alias("n_grounded"), F.array_join(lines, "; ").alias("top"))


@plans.add(f"""with {_OBSERVED}, kinds as (select distinct indicator from observed), names as (select distinct family, practice from observed)
select family, practice, indicator, count(o.effect) as n from names cross join kinds left join observed o using (family, practice, indicator) group by 1, 2, 3""")
def candidate_counts(spark, d):
    """Evidence of every candidate, zero where there is none."""
    return evidence.candidates(observed(spark, d), "family", "practice", "indicator")


@plans.add(f"""with {_OBSERVED}, n as (select family, indicator, count(*) as n from observed group by 1, 2)
select family, indicator, n from n where not (family = 'ASIA' and indicator = 'R')""")
def supported_pairs(spark, d):
    rows = observed(spark, d)
    counts = rows.groupBy("family", "indicator").agg(F.count(F.lit(1)).alias("n"))
    hidden = spark.createDataFrame([("ASIA", "R")], "family string, indicator string")
    return evidence.supported(rows.select("family", "indicator").distinct(), counts, hidden)


@plans.add(f"""with {_RANKED}, moved as (select case when practice like '%1' then 'MARS' else family end as family, practice, indicator from ranked)
select family, practice, indicator from moved where family = 'MARS'""")
def outside_family(spark, d):
    """Ranked practices that their family does not have: those that are moved to another family here."""
    moved = ranked(spark, d).withColumn("family", F.when(F.col("practice").like("%1"), "MARS").otherwise(F.col("family")))
    return evidence.outside_family(moved, observed(spark, d), "family", "practice").select("family", "practice", "indicator")


@plans.add(f"with {_OBSERVED} select family, string_agg(distinct practice, ', ' order by practice) as practices from observed group by 1")
def practice_lists(spark, d):
    return evidence.practices_by_family(observed(spark, d), "family", "practice").select("family", F.array_join("practices", ", ").alias("practices"))


@plans.add(f"with {_RANKED} select family, practice, indicator, case when direction > 0 then pct_change >= 0 else pct_change <= 0 end as beneficial from ranked")
def beneficial_flags(spark, d):
    return ranked(spark, d).select("family", "practice", "indicator", evidence.is_beneficial(F.col("pct_change"), F.col("direction")).alias("beneficial"))


_STEPS = [
    ("scope", "l_returnflag in ('A', 'R')"),
    ("quantity", "l_quantity between 2 and 49"),
    ("positive", "l_extendedprice > 0 and l_discount > 0"),
    ("no outlier", "l_extendedprice / l_quantity <= 1500"),
]


@plans.add("select 0 as stage, 'all' as step, count(*) as n from lineitem" + "".join(
    f" union all select {i + 1}, '{n}', count(*) from lineitem where " + " and ".join(f"({c})" for _, c in _STEPS[: i + 1]) for i, (n, _) in enumerate(_STEPS)))
def prep_funnel(spark, d):
    """Rows left after each preparation step, in one pass."""
    return prepare.funnel(table(spark, d, "lineitem"), [(n, F.expr(c)) for n, c in _STEPS])


@plans.add("""select source, key, substr(key, length(source) + 2) as bare, nation from (
  select distinct 'C' as source, 'C_' || c_custkey as key, c_nationkey as nation from customer
  union all select distinct 'S', 'S_' || s_suppkey, s_nationkey from supplier)""")
def union_tag_dedupe(spark, d):
    parts = {
        "C": table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation")),
        "S": table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation")),
    }
    both = prepare.drop_exact(prepare.tagged_union(parts, "key"), ["key", "nation"], "source")
    return both.withColumn("bare", F.when(F.col("source") == "C", prepare.strip_prefix(F.col("key"), "C")).otherwise(prepare.strip_prefix(F.col("key"), "S")))


@plans.add("""select p_partkey, label from part join (values ('economy', 'cheap'), ('small', 'little'), ('standard', 'usual')) v(raw, label)
  on lower(trim(p_type)) = raw""")
def canonical_labels(spark, d):
    labels = spark.createDataFrame([("Economy ", "cheap"), ("small", "little"), ("STANDARD", "usual")], "raw string, label string")
    return prepare.canonical(table(spark, d, "part").select("p_partkey", F.col("p_type").alias("label0")), "label0", labels).select("p_partkey", F.col("label0").alias("label"))


@plans.add("""select c_custkey, lat, lon, lat between 3.3 and 14.9 and lon between 32.9 and 48.2 and lat <> 0 and lon <> 0 as inside
  from (select c_custkey, c_acctbal / 500 as lat, c_acctbal / 200 + 20 as lon from customer)""")
def bounding_box(spark, d):
    points = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 500).alias("lat"), (F.col("c_acctbal") / 200 + 20).alias("lon"))
    return points.withColumn("inside", prepare.in_bounds(F.col("lat"), F.col("lon")))


@plans.add("""select o_orderkey, trim(case when o_totalprice > 100000 then 'challenge' else '' end || case when o_orderstatus = 'O' then ' objective' else '' end ||
  case when o_orderpriority like '1%' then ' location' else '' end) as missing from orders""")
def missing_slots(spark, d):
    flags = {"challenge": F.col("o_totalprice") > 100000, "objective": F.col("o_orderstatus") == "O", "location": F.col("o_orderpriority").like("1%")}
    return table(spark, d, "orders").select("o_orderkey", F.array_join(prepare.missing_names(flags), " ").alias("missing"))


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@plans.add(" union all ".join(f"select '{c}' as \"column\", min({c}) as minimum, max({c}) as maximum, round(avg({c}), 6) as mean from lineitem" for c in _NUMBERS))
def profile_numeric(spark, d):
    return quality.profile(table(spark, d, "lineitem"), _NUMBERS)


@plans.add(" union all ".join(f"select '{c}' as \"column\", count(*) filter (where {c} is null) as n_missing from labelled" for c in ("lang", "quality", "toxic")).join(
    ["with labelled as (select lang, quality, toxic from documents left join labels using (doc_id)) ", ""]))
def missing_report(spark, d):
    return quality.missing(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left"), ["lang", "quality", "toxic"])


@plans.add("select sum(n) as n_rows, sum(n - 1) as n_duplicates from (select count(*) as n from lineitem group by l_partkey, l_quantity, l_returnflag)")
def duplicate_report(spark, d):
    return quality.duplicates(table(spark, d, "lineitem"), ["l_partkey", "l_quantity", "l_returnflag"])


@plans.add(" union all ".join(f"select '{c}' as \"column\", count(distinct {c}) as n_distinct from part" for c in ("p_name", "p_brand", "p_type", "p_size")))
def cardinality(spark, d):
    return quality.cardinality(table(spark, d, "part"), ["p_name", "p_brand", "p_type", "p_size"])


@plans.add("select l_returnflag, count(l_extendedprice) as n, round(avg(l_extendedprice), 3) as mean, round(stddev_samp(l_extendedprice), 3) as std from lineitem group by 1")
def indicator_stats(spark, d):
    return quality.stats_by(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")


@plans.add("select p_type, count(*) as n from part group by 1")
def value_counts(spark, d):
    return quality.value_counts(table(spark, d, "part"), "p_type")


@plans.add("select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as \"F\", count(*) filter (where o_orderstatus = 'O') as \"O\", count(*) filter (where o_orderstatus = 'P') as \"P\" from orders group by 1")
def crosstab(spark, d):
    return quality.crosstab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@plans.add("select count(*) as n_groups, max(n) as max_rows from (select count(*) as n from lineitem group by l_suppkey)")
def largest_group(spark, d):
    return quality.largest_group(table(spark, d, "lineitem"), "l_suppkey")


_PAIRS = [(a, b) for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :]]


@plans.add("select * from (" + " union all ".join(f"select '{a}' as \"left\", '{b}' as \"right\", round(corr({a}, {b}), 6) as r from lineitem" for a, b in _PAIRS) + ") where abs(r) > 0.001")
def corr_pairs(spark, d):
    return quality.correlated(table(spark, d, "lineitem"), _NUMBERS, 0.001)


@plans.add(f"with {_OBSERVED} select indicator, bool_and(abs(exp(effect) - exp(effect + 1e-6)) <= 1e-8 + 1e-4 * abs(exp(effect + 1e-6))) as close from observed group by 1")
def allclose_invariant(spark, d):
    return observed(spark, d).groupBy("indicator").agg(quality.all_close(F.exp("effect"), F.exp(F.col("effect") + 1e-6)).alias("close"))


@plans.add("""with n as (select l_partkey, l_linestatus, count(*) as c from lineitem group by 1, 2),
own as (select l_partkey, l_linestatus from (select *, row_number() over (partition by l_partkey order by c desc, l_linestatus) as k from n) where k = 1),
b as (select p_brand, l_linestatus, count(*) as c from lineitem join part on l_partkey = p_partkey group by 1, 2),
wide as (select p_brand, l_linestatus from (select *, row_number() over (partition by p_brand order by c desc, l_linestatus) as k from b) where k = 1)
select p_partkey, coalesce(own.l_linestatus, wide.l_linestatus) as l_linestatus from part left join own on p_partkey = l_partkey left join wide using (p_brand)""")
def mode_fallback(spark, d):
    """The usual status of each part, or of its brand where the part was not sold."""
    line = table(spark, d, "lineitem").select("l_partkey", "l_linestatus")
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    return quality.mode_with_fallback(part.join(line, F.col("p_partkey") == F.col("l_partkey"), "left"), "p_partkey", "p_brand", "l_linestatus")


@plans.add("""with codes as (select p_brand, row_number() over (order by p_brand) - 1 as code from (select distinct p_brand from part where p_size <= 25))
select p_partkey, p_brand, coalesce(code, -1) as p_brand_code from part left join codes using (p_brand)""")
def category_encode(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return quality.encode(part, "p_brand", quality.category_codes(part.filter("p_size <= 25"), "p_brand")).select("p_partkey", "p_brand", "p_brand_code")


_HEX = "(strpos('0123456789abcdef', substr(md5({0}), 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(md5({0}), 2, 1)) - 1"
_FOLDED = f"""{_OBSERVED}, folded as (select *, ({_HEX.format("cast(study as varchar)")}) % 5 as fold from observed),
own as (select practice, indicator, fold, sum(effect) as s, count(*) as n from folded group by 1, 2, 3),
rest as (select *, sum(s) over (partition by practice, indicator) - s as rs, sum(n) over (partition by practice, indicator) - n as rn from own),
total as (select fold, sum(effect) as s, count(*) as n from folded group by 1),
overall as (select fold, (sum(s) over () - s) / (sum(n) over () - n) as m from total),
predicted as (select practice, indicator, rest.fold, case when rn > 0 then rs / rn else m end as predicted from rest join overall using (fold)),
oof as (select folded.*, predicted from folded join predicted using (practice, indicator, fold))"""
_METRICS = "count(*) as n, round(1 - sum((effect - predicted) * (effect - predicted)) / (var_pop(effect) * count(*)), 6) as r2, round(sqrt(sum((effect - predicted) * (effect - predicted)) / count(*)), 6) as rmse"


def oof(spark: SparkSession, d: str) -> DataFrame:
    rows = observed(spark, d).withColumn("fold", crossval.hash_fold(F.col("study"), 5))
    return crossval.oof_mean(rows, ["practice", "indicator"], "fold", "effect")


@plans.add(f"with {_FOLDED} select {_METRICS} from oof")
def fold_baseline_oof(spark, d):
    """R2 and RMSE of the group mean of the other folds."""
    return oof(spark, d).agg(*crossval.metrics("effect", "predicted"))


@plans.add(f"with {_FOLDED}, m as (select indicator, {_METRICS} from oof group by 1) select *, case when r2 >= 0.10 then 'high' when r2 >= 0 then 'medium' else 'low' end as confidence from m")
def ratio_metrics_by_group(spark, d):
    return oof(spark, d).groupBy("indicator").agg(*crossval.metrics("effect", "predicted")).withColumn("confidence", confidence(F.col("r2")))


@plans.add(f"""with {_OBSERVED}, g as (select study, row_number() over (order by md5('split' || cast(study as varchar)), study) as place, count(*) over () as k from (select distinct study from observed))
select place <= ceil(k * 0.25) as test, count(*) as n, count(distinct study) as groups from observed join g using (study) group by 1""")
def group_shuffle_split(spark, d):
    rows = crossval.shuffle_split(observed(spark, d), "study", 0.25, "split")
    return rows.groupBy("test").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("study").alias("groups"))


_LOADS = ["a", "b", "c", "e", "f"]


@plans.add(f"""with recursive s as (select l_suppkey, n, row_number() over (order by n desc, l_suppkey) as place from (select l_suppkey, count(*) as n from lineitem group by 1)),
w as (select cast(0 as bigint) as place, cast(null as bigint) as l_suppkey, cast(0 as bigint) as n, -1 as fold, {', '.join(f'cast(0 as bigint) as {x}' for x in _LOADS)}
  union all select s.place, s.l_suppkey, s.n, list_position([a, b, c, e, f], least(a, b, c, e, f)) - 1,
  {', '.join(f'{x} + case when list_position([a, b, c, e, f], least(a, b, c, e, f)) = {i + 1} then s.n else 0 end' for i, x in enumerate(_LOADS))} from w join s on s.place = w.place + 1)
select l_suppkey, n, cast(fold as bigint) as fold from w where place > 0""")
def greedy_folds(spark, d):
    """Balanced folds of suppliers by lines, each to the lightest fold."""
    return crossval.greedy_folds(table(spark, d, "lineitem"), "l_suppkey", 5)


def _model_rows(spark, d):
    line = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = line.select("p_type", "l_returnflag", "l_quantity", "l_discount", F.col("p_size").cast("double").alias("p_size"), F.log("l_extendedprice").alias("effect"), crossval.hash_fold(F.col("l_suppkey"), 3).alias("fold"))
    return rows


_CATS, _NUMS = ["p_type", "l_returnflag"], ["l_quantity", "l_discount", "p_size"]


@plans.add()
def forest_oof(spark, d):
    """R2 and RMSE of a random forest outside its folds."""
    stages = models.pipeline(models.forest(trees=20, depth=8), _CATS, _NUMS, "effect")
    return models.out_of_fold(_model_rows(spark, d), "fold", 3, stages).agg(*crossval.metrics("effect", "predicted"))


@plans.add()
def boosting_oof(spark, d):
    """R2 and RMSE of histogram boosting outside its folds; the trees of all folds grow together."""
    found = models.held_out(_model_rows(spark, d), models.boosting(rounds=10, step=0.3, depth=4), _CATS, _NUMS, "effect", "fold", 3)
    return found.agg(*crossval.metrics("effect", "predicted"))


_PRIORS = [*((c, "order by g / (n + 1), v") for c in ("p_type", "l_returnflag")), *((c, "order by cast(v as double)") for c in ("l_quantity", "l_discount", "p_size"))]


@plans.add(f"""with o as (select p_type, l_returnflag, l_quantity, l_discount, p_size, ln(l_extendedprice) as effect from lineitem join part on l_partkey = p_partkey),
b as (select avg(effect) as base, count(*) as rows from o),
{', '.join(f"{c}_c as (select cast({c} as varchar) as v, sum(base - effect) as g, count(*) as n from o cross join b group by 1)" for c, _ in _PRIORS)},
s as ({' union all '.join(f"select {i} as i, '{c}' as name, sum(g) over w as g, sum(n) over w as n from {c}_c window w as ({order} rows unbounded preceding)" for i, (c, order) in enumerate(_PRIORS))}),
k as (select *, g * g / (n + 1) + g * g / (rows - n + 1) as gain from s cross join b where n >= 20 and rows - n >= 20)
select name as feature, n as n_left, rows - n as n_right, round(gain, 3) as gain, round(base - g / (n + 1), 6) as left_value, round(base + g / (rows - n + 1), 6) as right_value
from k order by k.gain desc, i limit 1""")
def boosted_stump(spark, d):
    """The first split of boosting over all rows: its column, the rows and predictions of its sides, and what it gains."""
    rows = _model_rows(spark, d)
    model = models.fit(rows, models.boosting(rounds=1, step=1.0, depth=1), _CATS, _NUMS, "effect")
    tree = model.trees[0]
    name = model.binning.columns[tree.feature[0]]
    sides = model.transform(rows).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))
    left = F.col("prediction") == F.lit(model.base + float(tree.value[1]))
    gain = (F.col("n") + 1) * F.pow(F.col("prediction") - F.lit(model.base), 2)
    out = sides.agg(F.sum(F.when(left, F.col("n"))).alias("n_left"), F.sum(F.when(~left, F.col("n"))).alias("n_right"), F.round(F.sum(gain), 3).alias("gain"), F.round(F.max(F.when(left, F.col("prediction"))), 6).alias("left_value"), F.round(F.max(F.when(~left, F.col("prediction"))), 6).alias("right_value"))
    return out.select(F.lit(name).alias("feature"), "*")


@plans.add()
def permutation_importance(spark, d):
    rows = written(_model_rows(spark, d))  # the fit and the deals read it, and the join is made once
    model = models.pipeline(models.forest(trees=10, depth=6), _CATS, _NUMS, "effect").fit(rows)
    return models.permutation_importance(model, rows, [*_CATS, *_NUMS], "effect")


@plans.add("select doc_id from documents where doc_id not in (select doc_id from labels)")
def resume_antijoin(spark, d):
    return new_rows(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@plans.add(f"""with {_OBSERVED}, o as (select *, ({_HEX.format("cast(study as varchar)")}) % 5 as fold from observed), m as (select fold, avg(effect) as mean from o group by 1),
p as (select o.*, m.mean as predicted from o join m on m.fold = (o.fold + 1) % 5), own as (select fold, 1 - sum((effect - predicted) * (effect - predicted)) / nullif(var_pop(effect) * count(effect), 0) as r2,
  sqrt(sum((effect - predicted) * (effect - predicted)) / count(effect)) as rmse from p group by 1)
select count(*) as n_folds, round(avg(r2), 4) as r2, round(avg(rmse), 4) as rmse from own""")
def fold_metric_means(spark, d):
    """Each fold predicted by the mean of the next; the plain means of the folds' own figures."""
    rows = observed(spark, d).withColumn("fold", crossval.hash_fold(F.col("study"), 5))
    means = rows.groupBy("fold").agg(F.avg("effect").alias("predicted")).withColumn("fold", F.pmod(F.col("fold") + 4, F.lit(5)))
    found = crossval.fold_means(rows.join(means, "fold"), "fold", "effect", "predicted")
    return found.select("n_folds", F.round("r2", 4).alias("r2"), F.round("rmse", 4).alias("rmse"))


_PREDICTED = "cast(substring({0}, 7) as double) * 0.013 - rain * 0.0005"


@plans.add(f"""with {_OBSERVED}, names as (select distinct family, practice from observed), n as (select family, practice, indicator, count(*) as n from observed group by 1, 2, 3),
asked as (select n_nationkey as request, r_name as family, ['A', 'N', 'R'][n_nationkey % 3 + 1] as indicator, n_nationkey * 10.0 as rain from nation join region on n_regionkey = r_regionkey),
s as (select request, family, indicator, practice, coalesce(n.n, 0) as n, {_PREDICTED.format('practice')} as mean, case indicator when 'R' then -1 else 1 end as direction
  from asked join names using (family) left join n using (family, practice, indicator)),
r as (select *, row_number() over (partition by request order by direction * round_even(mean, 4) desc, practice) as rank from s where n > 0),
c as (select request, count(*) as n_candidates from s group by 1)
select request, family, indicator, case when any_value(direction) > 0 then 'increase' else 'reduce' end as goal_direction,
  case indicator when 'A' then 'high' when 'R' then 'medium' else 'low' end as confidence, any_value(n_candidates) as n_candidates, count(*) as n_grounded,
  string_agg(practice || ': ~' || cast(cast(round_even(abs(round_even((exp(mean) - 1) * 100, 1)), 0) as bigint) as varchar) || '% ' || case when direction > 0 then 'increase' else 'reduce' end || ' in ' || indicator, '; ' order by rank) filter (where rank <= 3) as top
from r join c using (request) group by 1, 2, 3""")
def scored_recommendation(spark, d):
    """The recommendation of a request in its context, by a model that is a formula here, so that SQL can follow it."""
    rows = observed(spark, d)
    asked = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    kind = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("n_nationkey") % 3 + 1)
    asked = asked.select(F.col("n_nationkey").cast("long").alias("request"), F.col("r_name").alias("family"), kind.alias("indicator"), (F.col("n_nationkey") * 10.0).alias("rain"))
    model = SQLTransformer(statement=f"select *, {_PREDICTED.format('practice')} as prediction from __THIS__")
    scored = evidence.score_candidates(evidence.candidates(rows, "family", "practice", "indicator"), asked, model)
    sure = spark.createDataFrame([("A", "high"), ("R", "medium")], "indicator string, confidence string")
    out = evidence.recommend_by_model(scored, "request", SIGNS, sure)
    lines = F.transform("recommendations", lambda x: F.concat(x["practice"], F.lit(": "), x["effect"]))
    return out.select("request", "family", "indicator", "goal_direction", F.col("details.confidence").alias("confidence"), F.col("details.n_candidates").alias("n_candidates"), F.col("details.n_grounded").alias("n_grounded"), F.array_join(lines, "; ").alias("top"))


@plans.add()
def model_recommendation(spark, d):
    """The same by the better of two tree models: chosen outside folds, fitted on all observations, with its confidence."""
    rows = observed(spark, d).withColumn("fold", crossval.hash_fold(F.col("study"), 3)).withColumn("rain", (F.col("study") % 25 * 10).cast("double"))
    kinds = {"forest": models.forest(trees=10, depth=6), "boosting": models.boosting(rounds=5, step=0.3)}
    model, figures = models.select_and_refit(rows, kinds, ["family", "practice", "indicator"], ["rain"], "effect", "fold", 3, "indicator")
    asked = rows.select("family", "indicator").distinct().withColumn("request", F.concat_ws("/", "family", "indicator")).withColumn("rain", F.lit(100.0))
    scored = evidence.score_candidates(evidence.candidates(rows, "family", "practice", "indicator"), asked, model)
    sure = figures.filter("scope <> 'all'").select(F.col("scope").alias("indicator"), "confidence")
    out = evidence.recommend_by_model(scored, "request", SIGNS, sure)
    return out.select("request", "goal_direction", F.col("details.confidence").alias("confidence"), F.col("details.n_grounded").alias("n_grounded"), F.to_json("recommendations").alias("recommendations"))


_CROPS = {"red": "maize", "blue": "teff", "green": "maize"}


@plans.add("""with c as (select p_partkey, split_part(lower(p_name), ' ', 1) as w from part), k as (select p_partkey, case w when 'red' then 'maize' when 'blue' then 'teff' when 'green' then 'maize' else w end as k from c)
select upper(k[1:1]) || k[2:] as crop, case when k = 'maize' or k = 'teff' then 'Cereals' else 'Other' end as crop_group, count(*) as n from k group by 1, 2""")
def crop_names(spark, d):
    """Spellings and synonyms of crops in one form, with their groups."""
    crop = prepare.crop_name(F.get(F.split("p_name", " "), F.lit(0)), _CROPS)
    found = table(spark, d, "part").select(crop.alias("crop"))
    return found.withColumn("crop_group", prepare.crop_group(F.col("crop"), {"Cereals": ["Maize", "Teff"]})).groupBy("crop", "crop_group").agg(F.count(F.lit(1)).alias("n"))


@plans.add("""select key, segment, count(*) as n, count(distinct round(balance)) as points from (select c_nationkey as key, c_mktsegment as segment, c_acctbal as balance from customer where c_mktsegment = 'BUILDING') group by 1, 2""")
def optional_filters(spark, d):
    """Renamed columns, a filter that is asked for and one that is not."""
    rows = prepare.renamed(table(spark, d, "customer"), {"c_nationkey": "key", "c_mktsegment": "segment", "c_acctbal": "balance", "not_there": "x"})
    rows = prepare.optional(prepare.without(rows, ["c_name", "c_custkey"]), segment="BUILDING", key=None)
    return rows.groupBy("key", "segment").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.round("balance")).alias("points"))


@plans.add("select c_custkey, n_name as name from customer left join (select n_nationkey, n_name from nation where n_nationkey % 2 = 0) on n_nationkey = c_nationkey")
def points_once(spark, d):
    """Customers as points of their nation: each distinct point is looked up once."""
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("lat"), F.lit(0).alias("lon"))
    known = table(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("lat"), F.col("n_name").alias("name"))
    return prepare.at_points(rows, "lat", "lon", lambda p: p.join(known, "lat")).select("c_custkey", "name")


@plans.add("""with l as (select lower(p_brand) as k, min_by(p_type, p_partkey) as p_type from part group by 1)
select r_regionkey, p_type from region left join l on l.k = lower('BRAND#1' || cast(r_regionkey as varchar))""")
def first_match(spark, d):
    """The first row whose key is equal in any case."""
    wanted = table(spark, d, "region").select("r_regionkey", F.concat(F.lit("BRAND#1"), F.col("r_regionkey").cast("string")).alias("brand"))
    return evidence.first_match(table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), "p_brand", "p_type", "p_partkey", wanted, "brand").select("r_regionkey", "p_type")


@plans.add("""with v as (select c_custkey, [c_acctbal, c_acctbal + 900, c_acctbal * 2] as v from customer)
select c_custkey, case when list_min(v) >= 0 then round(list_sum(v) / 3, 6) end as mean, case when v[1] <> 0 then round(v[1] * 0.1, 6) end as scaled, cast(trunc(v[1]) as bigint) as whole, round_even(v[1], 1) as places from v""")
def guarded_numbers(spark, d):
    """Means over years with a mark of no data, scaled units, and cells that read as numbers."""
    from siltstone.functions import numbers

    b = F.col("c_acctbal")
    text = b.cast("string")
    return table(spark, d, "customer").select(
        "c_custkey", F.round(numbers.multi_year_mean(F.array(b, b + 900, b * 2)), 6).alias("mean"), F.round(numbers.scaled(b, F.lit(0.0)), 6).alias("scaled"),
        numbers.safe_int(text).alias("whole"), numbers.safe_float(text, 1).alias("places"),
    )


@plans.add("""select count(*) as n, count(*) filter (where o_totalprice > 200000) as n_large, count(*) filter (where o_orderstatus = 'F') as n_done from orders""")
def answer_counters(spark, d):
    from siltstone.operators.serving import counters

    return counters(table(spark, d, "orders"), {"large": F.col("o_totalprice") > 200000, "done": F.col("o_orderstatus") == "F"})
