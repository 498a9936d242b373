"""What messages and conversations say: objectives, challenges, acknowledgements, slots; zones and caps."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import classify, grid, sampling, slots
from siltstone.plans.base import Plans
from siltstone.sources.files import table

plans = Plans()

#: Message forms around the words of a conversation: phrases, labels, families and cues of the rules, in turn.
_CUES = [w for words in slots.SOFT.values() for w in words]
_LISTS = {"phrase": [p for p, _ in slots.PHRASES], "label": [x for x, _ in slots.LABELS], "fam": list(slots.FAMILIES), "cue": _CUES, "thanks": ["Thanks", "thank  you", "OK", "sounds  good", "Got it", "that helps", "why", "great"], "end": ["!!", ".", " ! ", "", " then"]}


def _quoted(x: str | None) -> str:
    return "null" if x is None else "'" + x.replace("'", "''") + "'"


def _listed(values: list[str]) -> str:
    return "[" + ", ".join(map(_quoted, values)) + "]"


_K = "(conv_id * 31 + turn * 7)"
_PICKED = ", ".join(f"{_listed(v)}[{_K} % {len(v)} + 1] as {n}" for n, v in _LISTS.items())
_SAID_SQL = f"""said as (select *, case k % 6 when 0 then 'My objective is to ' || phrase || ' ' || w || '.' when 1 then ' my objective is to ' || label when 2 then 'My challenge is ' || fam || '.'
  when 3 then w || ' ' || phrase || ' ' || cue when 4 then label || ' ' || w else text end as said from (select conv_id, turn, role, text, {_K} as k, split_part(text, ' ', 2) as w, {_PICKED} from conversations))"""


def _said(spark, d):
    """Turns of conversations with k, w and said: their words in the forms that the rules know."""
    k = F.expr(_K)
    picked = {n: F.element_at(F.array(*map(F.lit, v)), (k % len(v) + 1).cast("int")) for n, v in _LISTS.items()}
    rows = table(spark, d, "conversations").withColumns({"k": k, "w": F.split_part("text", F.lit(" "), F.lit(2))} | picked)
    form = F.when(k % 6 == 0, F.concat(F.lit("My objective is to "), "phrase", F.lit(" "), "w", F.lit("."))).when(k % 6 == 1, F.concat(F.lit(" my objective is to "), "label")).when(k % 6 == 2, F.concat(F.lit("My challenge is "), "fam", F.lit(".")))
    return rows.withColumn("said", form.when(k % 6 == 3, F.concat_ws(" ", "w", "phrase", "cue")).when(k % 6 == 4, F.concat("label", F.lit(" "), "w")).otherwise(F.col("text")))


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace(lower({x}), '-', ' '), '[/|,;:]+', ' ', 'g'), '\s+', ' ', 'g'))"


def _family_sql(x: str) -> str:
    counts = ["(" + " + ".join(f"cast(contains(lower({x}), '{w}') as int)" for w in words) + ")" for words in slots.SOFT.values()]
    ranked = f"list_reverse_sort([{', '.join(counts)}])"
    best = "case " + " ".join(f"when {c} = {ranked}[1] then '{f}'" for f, c in zip(slots.SOFT, counts, strict=True)) + " end"
    named = "case " + " ".join(f"when contains(lower({x}), '{k}') then '{f}'" for k, f in slots.KEYWORDS) + " end"
    return (f"case when {named} is not null then {{'v': {named}, 'by': 'high'}} when {ranked}[1] >= 2 then {{'v': {best}, 'by': 'medium'}} "
        f"when {ranked}[1] = 1 and {ranked}[2] = 0 then {{'v': {best}, 'by': 'low'}} end")  # fmt: skip


def _indicator_sql(x: str) -> str:
    t = _norm(x)
    label = "case " + " ".join(f"when contains({t}, {_norm(_quoted(k))}) or {t} = lower('{v}') then '{v}'" for k, v in slots.LABELS) + " end"
    longest = sorted(slots.PHRASES, key=lambda p: -len(p[0]))
    loose = "case " + " ".join(f"when contains({t}, '{p}') then {{'v': '{v}', 'by': '{'high' if len(p) >= 8 else 'medium'}'}}" for p, v in longest) + " end"
    return f"coalesce(case when {label} is not null then {{'v': {label}, 'by': 'high'}} end, {loose})"


def _stated_sql(x: str) -> str:
    """The objective with its stated forms."""
    rest = _norm(rf"regexp_extract({x}, '{slots.OBJECTIVE}', 1)")
    found = [f"when contains({rest}, '{p}') or {rest} = lower('{k}') then '{k}'" for p, k in slots.PHRASES]
    found += [f"when contains({rest}, {_norm(_quoted(t))}) or contains({_norm(_quoted(t))}, {rest}) then '{k}'" for t, k in slots.LABELS]
    return f"coalesce(case when regexp_extract({x}, '{slots.OBJECTIVE}', 1) <> '' then {{'v': case {' '.join(found)} end, 'by': 'high'}} end, {{'v': null, 'by': 'high'}})"


def _any_indicator_sql(x: str) -> str:
    return f"case when ({_stated_sql(x)}).v is not null then {_stated_sql(x)} else {_indicator_sql(x)} end"


def _any_family_sql(x: str) -> str:
    said = rf"lower(trim(regexp_extract({x}, '{slots.CHALLENGE}', 1)))"
    return f"case {' '.join(f'when {said} = lower({_quoted(f)}) then ' + chr(123) + f'{chr(39)}v{chr(39)}: {_quoted(f)}, {chr(39)}by{chr(39)}: {chr(39)}high{chr(39)}' + chr(125) for f in slots.FAMILIES)} else {_family_sql(x)} end"


@plans.add(f"""with {_SAID_SQL}, r as (select conv_id, turn, {_any_indicator_sql('said')} as i, {_any_family_sql('said')} as f from said)
select conv_id, turn, i.v as indicator, i.by as indicator_by, f.v as family, f.by as family_by from r""")
def stated_slots(spark, d):
    """Objectives and challenges of messages in stated, short and loose forms."""
    rows = _said(spark, d).select("conv_id", "turn", slots.indicator(F.col("said")).alias("i"), slots.family(F.col("said")).alias("f"))
    return rows.select("conv_id", "turn", F.col("i.key").alias("indicator"), F.col("i.confidence").alias("indicator_by"), "f.family", F.col("f.confidence").alias("family_by"))


@plans.add(f"""with {_SAID_SQL} select conv_id, turn, regexp_matches(thanks || "end" || case when k % 3 = 0 then ' ' || w else '' end, '{slots.SOCIAL}') as social from said""")
def social_acknowledgements(spark, d):
    """Whether a message only thanks or agrees; some go on with a word of the conversation."""
    more = F.when(F.col("k") % 3 == 0, F.concat(F.lit(" "), "w")).otherwise("")
    return _said(spark, d).select("conv_id", "turn", slots.social(F.concat("thanks", "end", more)).alias("social"))


_CROP_SQL = "case " + " ".join(rf"when regexp_matches(lower({{0}}), '\b{c}\b') then '{c.title()}'" for c in classify.CROPS) + " end"


@plans.add(rf"""with t as (select conv_id, turn, text as own, array_to_string(list(text) over (partition by conv_id order by turn rows between 19 preceding and current row), chr(10)) as whole from conversations where role = 'user'),
r as (select conv_id, turn, own, coalesce({_family_sql('own')}, {_family_sql('whole')}) as f, coalesce({_indicator_sql('own')}, {_indicator_sql('whole')}) as i, coalesce({_CROP_SQL.format('own')}, {_CROP_SQL.format('whole')}) as crop from t),
u as (select *, coalesce(f, case when (i.v not in ('soil loss', 'runoff') or i.by = 'high' or {" or ".join(f"contains(lower(own), '{w}')" for w in slots.SOFT[slots.EROSION])})
  then case i.v {" ".join(f"when '{k}' then {{'v': '{v}', 'by': 'inferred'}}" for k, v in slots.DEFAULT_FAMILY.items())} end end) as g from r)
select conv_id, turn, g.v as family, g.by as family_by, coalesce(i.v, j) as indicator, coalesce(i.by, case when j is not null then 'inferred' end) as indicator_by, crop
  from (select *, case when i is null and g.v = '{slots.EROSION}' and regexp_matches(lower(own), 'soil|eros|slope|runoff|wash') then case when contains(lower(own), 'runoff') then 'runoff' else 'soil loss' end end as j from u)""")
def conversation_slots(spark, d):
    """The slots that each message of a user leaves a conversation with."""
    turns = table(spark, d, "conversations").filter("role = 'user'")
    return slots.conversation_slots(turns, "conv_id", "turn", "text").select("conv_id", "turn", "family", "family_by", "indicator", "indicator_by", "crop")


#: The pairs that the evidence has here, places by parts of invented words, and what recommendations were asked for.
_KEYS = list(slots.DEFAULT_FAMILY)
_PAIRS = [(f, k) for i, f in enumerate(slots.FAMILIES) for j, k in enumerate(_KEYS) if slots.DEFAULT_FAMILY[k] == f and j != 2 or (i + j) % 3 == 0]
_PLACES = [(1, "thin", 9.0, 38.5), (2, "hein", 8.0, 37.5), (3, "erst", 7.5, 39.0), (4, "whor er", 6.0, 40.0), (5, "nandle", 10.0, 36.0)]
_FOLDED = r"trim(regexp_replace(regexp_replace(strip_accents(lower({0})), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _place_sql(x: str) -> str:
    ranked = sorted(_PLACES, key=lambda p: (-len(p[1]), p[0]))
    return "case " + " ".join(f"when contains({_FOLDED.format(x)}, '{a}') then {{'place': '{a.title()}', 'lat': {lat}, 'lon': {lon}}}" for _, a, lat, lon in ranked) + " end"


def _usual(x: str) -> str:
    return f"case {x} " + " ".join(f"when '{k}' then '{f}'" for k, f in slots.DEFAULT_FAMILY.items()) + " end"


_HELD = _listed([f"{f}|{k}" for f, k in _PAIRS])
_FOUND_BY = "case {0} when 'high' then 3 when 'medium' then 2 when 'inferred' then 1 else 0 end"


@plans.add(rf"""with {_SAID_SQL}, g as (select *, case when role <> 'user' and k % 3 <> 1 then {{'family': fam, 'indicator': {_listed(_KEYS)}[k % 7 + 1], 'lat': 5.5 + k % 9, 'lon': 35.0 + k % 10, 'crop': case when k % 4 = 0 then '' else 'Teff' end}} end as given from said),
q as (select conv_id, turn, role, said as own, last_value(given ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as prior from g),
t as (select *, array_to_string(list(own) over (partition by conv_id order by turn rows between 19 preceding and current row), chr(10)) as whole from q where role = 'user'),
r as (select *, {_any_family_sql('own')} as fo, {_any_family_sql('whole')} as fw, {_any_indicator_sql('own')} as io, {_any_indicator_sql('whole')} as iw, coalesce({_CROP_SQL.format('own')}, nullif(prior.crop, ''), {_CROP_SQL.format('whole')}) as crop,
  case when prior is null then coalesce({_place_sql('own')}, {_place_sql('whole')}) end as pl from t),
s as (select *, coalesce(fo, case when prior is not null then {{'v': prior.family, 'by': 'prior'}} end, fw) as f1, coalesce(io, case when prior is not null then {{'v': prior.indicator, 'by': 'prior'}} end, iw) as i1 from r),
u as (select *, {_usual('i1.v')} as usual, list_contains({_HELD}, {_usual('i1.v')} || '|' || i1.v) as fits from s),
v as (select *, coalesce(f1, case when fits and (i1.v not in ('soil loss', 'runoff') or i1.by = 'high' or {" or ".join(f"contains(lower(own), '{w}')" for w in slots.SOFT[slots.EROSION])}) then {{'v': usual, 'by': 'inferred'}} end) as f2 from u),
w2 as (select *, coalesce(i1, case when f2.v = '{slots.EROSION}' and regexp_matches(lower(own), 'soil|eros|slope|runoff|wash') then {{'v': case when contains(lower(own), 'runoff') then 'runoff' else 'soil loss' end, 'by': 'inferred'}} end) as i2 from v),
x as (select *, f2 is not null and i2 is not null and not list_contains({_HELD}, f2.v || '|' || i2.v) as apart, {_FOUND_BY.format('f2.by')} >= {_FOUND_BY.format('i2.by')} as first from w2),
y as (select *, case when apart and not first then null else f2 end as f3, case when apart and first then null else i2 end as i3 from x),
z as (select *, coalesce(f3, case when list_contains({_HELD}, {_usual('i3.v')} || '|' || i3.v) then {{'v': {_usual('i3.v')}, 'by': 'inferred'}} end) as f4 from y)
select conv_id, turn, f4.v as family, f4.by as family_by, i3.v as indicator, i3.by as indicator_by, crop, pl.place as place, coalesce(prior.lat, pl.lat) as lat, coalesce(prior.lon, pl.lon) as lon,
  array_to_string(list_filter([case when f4 is null then 'challenge' end, case when i3 is null then 'objective' end, case when prior is null and pl is null then 'location' end], lambda m: m is not null), ' ') as missing from z""")
def remembered_slots(spark, d):
    """Slots of messages with what was recommended before, places by name, and the pairs that the evidence has."""
    k = F.col("k")
    kind = F.element_at(F.array(*map(F.lit, _KEYS)), (k % 7 + 1).cast("int"))
    asked = F.struct(F.col("fam").alias("family"), kind.alias("indicator"), (F.lit(5.5) + k % 9).alias("lat"), (F.lit(35.0) + k % 10).alias("lon"), F.when(k % 4 == 0, "").otherwise("Teff").alias("crop"))
    given = F.when((F.col("role") != "user") & (k % 3 != 1), asked)
    place = classify.place_finder(spark.createDataFrame(_PLACES, "pos int, alias string, lat double, lon double"), phrases=False)
    found = slots.conversation_slots(_said(spark, d), "conv_id", "turn", "said", user=F.col("role") == "user", prior=given, supported=_PAIRS, place=place)
    return found.select("conv_id", "turn", "family", "family_by", "indicator", "indicator_by", "crop", "place", "lat", "lon", F.array_join("missing", " ").alias("missing"))


@plans.add("select n_nationkey, n_nationkey between 4 and 10 as within_extent, cast(round(n_nationkey * 230400000.0 / (110.57 * 111.32)) as bigint) as n_cells from nation")
def zone_cells(spark, d):
    """Zones in the extent of a raster, and about how many of its cells they cover."""
    n = F.col("n_nationkey").cast("double")
    zones = table(spark, d, "nation").select("n_nationkey", n.alias("lat_min"), (n + 4.5).alias("lat_max"), (n + 30).alias("lon_min"), (n + 35).alias("lon_max"), (n * 1000).alias("area_km2"))
    return grid.zone_cells(zones, 3.3, 33.5, 14.9, 48.2).select("n_nationkey", "within_extent", "n_cells")


@plans.add("select c_custkey from (select * from customer order by c_custkey limit 100) where c_acctbal > 0 order by c_custkey limit 20")
def scan_caps(spark, d):
    """The first records of a stream that are wanted, under a cap of what is read and one of what is kept."""
    return sampling.scan_caps(table(spark, d, "customer"), "c_custkey", F.col("c_acctbal") > 0, 100, 20).select("c_custkey")
