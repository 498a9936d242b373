"""What a conversation says: objectives, challenges, acknowledgements, and the slots of each turn."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import norm_match
from siltstone.operators import classify
from siltstone.operators.evidence import DIRECTIONS

# Patterns, word lists and labels.
OBJECTIVE = r"(?i)^\s*my objective is to\s+(.+?)\.?\s*$"
CHALLENGE = r"(?i)^\s*my challenge is\s+(.+?)\.?\s*$"
SOCIAL = (
    r"(?i)^\s*(?:thanks|thank\s*you|thx|ty|ok|okay|alright|all\s*right|great|cool|nice|perfect|awesome|appreciated|much\s*appreciated|"
    r"bye|goodbye|see\s*you|cheers|got\s*it|sounds\s*good|that\s*helps|helpful)[\s!.]*$"
)
EROSION, FERTILITY, LIVESTOCK = "Erosion control and water management", "Integrated soil fertility management", "Livestock production and management"
FOREST, CROP = "Agro-forestry and forest management", "Crop production and management"
FAMILIES = (CROP, LIVESTOCK, FERTILITY, EROSION, FOREST)
PHRASES = (
    ("increase crop yield", "yield"), ("increase yield", "yield"), ("raise yield", "yield"), ("higher yield", "yield"), ("crop yield", "yield"),
    ("biomass yield", "biomass yield"), ("increase biomass", "biomass yield"), ("fodder", "biomass yield"), ("forage", "biomass yield"),
    ("increase income", "income"), ("more income", "income"), ("profit", "income"),
    ("improve water use efficiency", "water use efficiency"), ("water use efficiency", "water use efficiency"), ("water efficiency", "water use efficiency"),
    ("use water better", "water use efficiency"), ("wue", "water use efficiency"),
    ("improve soil organic matter", "SOM content"), ("soil organic matter", "SOM content"), ("organic matter", "SOM content"), ("soil health", "SOM content"),
    ("reduce soil loss", "soil loss"), ("soil loss", "soil loss"), ("soil erosion", "soil loss"), ("cut erosion", "soil loss"), ("control erosion", "soil loss"),
    ("stop erosion", "soil loss"), ("prevent erosion", "soil loss"), ("erosion", "soil loss"), ("reduce runoff", "runoff"), ("runoff", "runoff"),
    ("yield", "yield"), ("income", "income"),
)
LABELS = (
    ("increase crop yield", "yield"), ("increase biomass / fodder", "biomass yield"), ("increase biomass fodder", "biomass yield"), ("increase income", "income"),
    ("improve water use efficiency", "water use efficiency"), ("improve soil organic matter", "SOM content"), ("reduce soil loss / erosion", "soil loss"),
    ("reduce soil loss erosion", "soil loss"), ("reduce runoff", "runoff"),
)
KEYWORDS = (
    ("erosion control and water management", EROSION), ("erosion control", EROSION), ("water management", EROSION),
    ("integrated soil fertility management", FERTILITY), ("soil fertility", FERTILITY),
    ("livestock production and management", LIVESTOCK), ("livestock", LIVESTOCK),
    ("agro-forestry and forest management", FOREST), ("agroforestry", FOREST), ("agro-forestry", FOREST), ("forest management", FOREST),
    ("crop production and management", CROP), ("crop production", CROP),
)
SOFT = {
    CROP: ("planting", "sowing", "intercrop", "rotation", "mulch"),
    LIVESTOCK: ("livestock", "cattle", "goat", "sheep", "dairy", "herd", "fodder", "forage"),
    FERTILITY: ("fertil", "compost", "manure", "nutrient", "soil fertility"),
    EROSION: ("slope", "sloping", "sloped", "steep", "hillside", "gully", "bund", "terrace", "contour", "runoff", "erosion", "soil loss", "wash away", "washed away"),
    FOREST: ("tree", "forest", "woodlot", "agroforest"),
}
DEFAULT_FAMILY = {
    "soil loss": EROSION, "runoff": EROSION, "water use efficiency": EROSION, "SOM content": FERTILITY, "biomass yield": LIVESTOCK, "income": CROP, "yield": CROP,
}
TERRAIN = ("soil", "eros", "slope", "runoff", "wash")
FAMILY_LABELS = {
    (LIVESTOCK, "biomass yield"): "Increase fodder & forage biomass",
    (EROSION, "yield"): "Increase yield while protecting soil",
    (FOREST, "yield"): "Increase crop & tree productivity",
}


def _sure(key: Column) -> Column:
    return F.when(key.isNotNull(), F.struct(key.alias("key"), F.lit("high").alias("confidence")))


def indicator(text: Column) -> Column:
    """struct<key, confidence>: a stated objective by phrase or label, then a label anywhere, then the longest phrase; null if none."""
    labels = [(norm_match(F.lit(x)), k) for x, k in LABELS]

    def stated(rest):
        found = [F.when(F.contains(rest, F.lit(p)) | (rest == norm_match(F.lit(k))), F.lit(k)) for p, k in PHRASES]
        return F.coalesce(*found, *[F.when(F.contains(rest, x) | F.contains(x, rest), F.lit(k)) for x, k in labels])

    def short(whole):
        return F.coalesce(*[F.when(F.contains(whole, x) | (whole == norm_match(F.lit(k))), F.lit(k)) for x, k in labels])

    said = F.regexp_extract(F.coalesce(text, F.lit("")), OBJECTIVE, 1)
    return F.coalesce(_sure(F.when(said != "", classify.let(norm_match(said), stated))), _sure(classify.let(norm_match(text), short)), classify.longest_phrase(text, PHRASES))


def family(text: Column) -> Column:
    """struct<family, confidence>: a stated challenge by its whole name, then keywords in order, then soft cues; null if none."""
    said = F.lower(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), CHALLENGE, 1)))
    named = F.coalesce(*[F.when(said == f.lower(), F.lit(f)) for f in FAMILIES])
    return F.coalesce(F.when(named.isNotNull(), F.struct(named.alias("family"), F.lit("high").alias("confidence"))), classify.family(text, KEYWORDS, SOFT))


def social(text: Column) -> Column:
    """Whether a message only thanks, agrees or takes leave."""
    return F.coalesce(F.rlike(text, F.lit(SOCIAL)), F.lit(False))


def family_label(chosen: Column, key: Column, label: Column) -> Column:
    """An indicator's label, put for the family where it would mislead."""
    return F.coalesce(*[F.when((chosen == f) & (key == k), F.lit(x)) for (f, k), x in FAMILY_LABELS.items()], label)


def _any(text: Column, words: Sequence[str]) -> Column:
    low = F.lower(text)
    return F.greatest(*[F.contains(low, F.lit(w)) for w in words], F.lit(False))


#: Weights of how a slot was found, where two do not belong together.
STRENGTH = {"high": 3, "medium": 2, "inferred": 1, "prior": 0, "low": 0}
#: What a recommendation was asked for, as later messages know it.
PRIOR = "struct<family: string, indicator: string, lat: double, lon: double, crop: string>"


def remembered(turns: DataFrame, conv: str, turn: str, text: str, user: Column, prior: Column | None = None, most: int = 20) -> DataFrame:
    """conv, turn, own, whole, prior for each message of a user: itself, the last `most` messages together, and the last
    recommendation (a PRIOR at the turn that gave it) before it."""
    before = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(conv).orderBy(turn).rowsBetween(1 - most, Window.currentRow)
    known = F.lit(None).cast(PRIOR) if prior is None else prior
    rows = turns.select(conv, turn, F.coalesce(F.col(text), F.lit("")).alias("own"), user.alias("_user"), known.alias("_given"))
    rows = rows.withColumn("prior", F.last("_given", ignorenulls=True).over(before)).filter("_user")
    return rows.select(conv, turn, "own", F.array_join(F.collect_list("own").over(back), "\n").alias("whole"), "prior")


def _belong(chosen: Column, key: Column, supported: Sequence[tuple[str, str]] | None) -> Column:
    """Whether the evidence has the family with the indicator."""
    if supported is None:
        return F.lit(True)
    return F.coalesce(F.array_contains(F.array(*[F.lit(f"{f}|{k}") for f, k in supported]), F.concat_ws("|", chosen, key)), F.lit(False)) if supported else F.lit(False)


def _strength(by: Column) -> Column:
    return F.coalesce(*[F.when(by == k, F.lit(v)) for k, v in STRENGTH.items()], F.lit(0))


def supported_pairs(df: DataFrame, family: str, indicator: str) -> list[tuple[str, str]]:
    """The (family, indicator) pairs of an evidence table among the known ones; at most as many as there are of those."""
    known = df.filter(F.col(family).isin(*FAMILIES) & F.col(indicator).isin(*DIRECTIONS))
    return sorted((r[0], r[1]) for r in known.select(family, indicator).distinct().collect())


def read_slots(rows: DataFrame, supported: Sequence[tuple[str, str]] | None = None, place: Callable[[Column], Column] | None = None) -> DataFrame:
    """rows (own, whole, prior and others) with the slots of each message; for batches and streams alike.

    family, indicator, lat, lon, crop, place, each with what it was found by (_by) but crop and place; inferred and
    missing, arrays of names; complete.  The message itself decides, then the recommendation before it, then the last
    messages together.  place(text) gives a struct<place, lat, lon>, used where no coordinates are known.  A clear objective
    brings its usual family, and the erosion family an objective where the message speaks of the ground.  Of a family and
    an indicator that the evidence has not together, the weaker goes, the indicator if they are equal; an indicator
    left alone gets its usual family back if that one is supported.
    """
    both = lambda one: (one(F.col("own")), one(F.col("whole")))
    (own_f, all_f), (own_i, all_i) = both(family), both(indicator)
    by = lambda value, name, how: F.when(value.isNotNull(), F.struct(value.alias(name), F.lit(how).alias("confidence")))
    prior_f = F.when(F.col("prior.family").isin(*FAMILIES), F.col("prior.family"))
    prior_i = F.when(F.col("prior.indicator").isin(*DIRECTIONS), F.col("prior.indicator"))
    prior_at = F.when(F.col("prior.lat").isNotNull() & F.col("prior.lon").isNotNull(), F.struct(F.col("prior.lat").alias("lat"), F.col("prior.lon").alias("lon"), F.lit("prior").alias("by")))
    found = lambda at, how="high": F.when(at.isNotNull(), F.struct(at["lat"].alias("lat"), at["lon"].alias("lon"), F.lit(how).alias("by")))
    (own_at, all_at), (own_c, all_c) = both(classify.coordinates), both(lambda t: classify.first_word(t, classify.CROPS))
    rows = rows.withColumns({
        "_f": F.coalesce(own_f, by(prior_f, "family", "prior"), all_f), "_i": F.coalesce(own_i, by(prior_i, "key", "prior"), all_i),
        "_at": F.coalesce(found(own_at), prior_at, found(all_at)), "crop": F.coalesce(own_c, F.nullif(F.col("prior.crop"), F.lit("")), all_c),
    })
    rows = rows.withColumn("_place", F.when(F.col("_at").isNull(), F.coalesce(*both(place))) if place else F.lit(None).cast("struct<place: string, lat: double, lon: double>"))
    usual = F.coalesce(*[F.when(F.col("_i.key") == k, F.lit(f)) for k, f in DEFAULT_FAMILY.items()])
    fits = usual.isNotNull() & _belong(usual, F.col("_i.key"), supported)
    clear = ~F.col("_i.key").isin("soil loss", "runoff") | _any(F.col("own"), SOFT[EROSION]) | (F.col("_i.confidence") == "high")
    rows = rows.withColumn("_f", F.coalesce("_f", by(F.when(fits & clear, usual), "family", "inferred")))
    ground = (F.col("_f.family") == EROSION) & _any(F.col("own"), TERRAIN)
    meant = F.when(_any(F.col("own"), ["runoff"]), "runoff").otherwise("soil loss")
    rows = rows.withColumn("_i", F.coalesce("_i", by(F.when(ground, meant), "key", "inferred")))
    apart = F.col("_f").isNotNull() & F.col("_i").isNotNull() & ~_belong(F.col("_f.family"), F.col("_i.key"), supported)
    rows = rows.withColumn("_keep", F.when(~apart, "both").when(_strength(F.col("_f.confidence")) >= _strength(F.col("_i.confidence")), "family").otherwise("indicator"))
    rows = rows.withColumns({"_f": F.when(F.col("_keep") != "indicator", F.col("_f")), "_i": F.when(F.col("_keep") != "family", F.col("_i"))})
    rows = rows.withColumn("_f", F.coalesce("_f", by(F.when(fits, usual), "family", "inferred")))
    named = F.col("_place").isNotNull()
    guessed = {"location": named, "practice_family": F.col("_f.confidence") == "inferred", "indicator": F.col("_i.confidence") == "inferred"}
    lacking = {"challenge": F.col("_f").isNull(), "objective": F.col("_i").isNull(), "location": F.col("_at").isNull() & ~named}
    listed = lambda flags: F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]))
    return rows.withColumns({
        "family": F.col("_f.family"), "family_by": F.col("_f.confidence"), "indicator": F.col("_i.key"), "indicator_by": F.col("_i.confidence"),
        "lat": F.coalesce("_at.lat", "_place.lat"), "lon": F.coalesce("_at.lon", "_place.lon"), "location_by": F.coalesce("_at.by", F.when(named, "high")), "place": F.col("_place.place"),
        "inferred": listed(guessed), "missing": listed(lacking), "complete": F.size(listed(lacking)) == 0,
    }).drop("_f", "_i", "_at", "_place", "_keep", "own", "whole", "prior")


def conversation_slots(
    turns: DataFrame, conv: str, turn: str, text: str, most: int = 20, user: Column | None = None, prior: Column | None = None, supported: Sequence[tuple[str, str]] | None = None, place: Callable[[Column], Column] | None = None
) -> DataFrame:
    """conv, turn and the slots of read_slots() for each message of a user (all rows, if `user` is left out)."""
    rows = remembered(turns, conv, turn, text, F.lit(True) if user is None else F.coalesce(user, F.lit(False)), prior, most)
    return read_slots(rows, supported, place)
