"""Keyword rules: classification by priority, intents, coordinates, crops, indicators, families, places."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.places import Names
from siltstone.functions.text import norm_match
from siltstone.operators.prepare import LAT, LON

# Patterns and word lists.
FOLLOW_UP = r"(?i)\b(why|explain|how\s+sure|evidence|confidence|detail|because|how\s+(?:do|to|can)|implement|apply|steps|alternativ|other\s+option|instead|compare|better|else)\b"
ADVICE = r"(?i)\b(recommend|suggest|what\s+(?:should|can)\s+i|help\s+me|want\s+to|need\s+to|how\s+(?:do|can)\s+i|reduce|increase|improve|practice|erosion|yield|soil|runoff|income|fodder)\b"
CROPS = ("maize", "teff", "wheat", "barley", "sorghum", "potato", "onion", "coffee", "bean", "chickpea", "lentil", "sesame", "rice")
PAIR = r"(-?\d{1,2}(?:\.\d+)?)\s*[,;\s]\s*(-?\d{1,2}(?:\.\d+)?)"
FARM_AT = r"(?i)(?:farm|field|plot|location|pin)?\s*(?:is\s+)?(?:at|@)\s*(-?\d{1,2}(?:\.\d+)?)\s*[,;]\s*(-?\d{1,2}(?:\.\d+)?)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def by_priority(text: Column, rules: Mapping[str, Sequence[str]], priority: Sequence[str], default: str) -> tuple[Column, Column, Column]:
    """Class, whether several classes matched, and whether none did: keywords count anywhere in the lower-case text."""
    low = F.lower(text)
    hit = {k: F.greatest(*[F.contains(low, F.lit(w)) for w in words], F.lit(False)) for k, words in rules.items()}
    found = F.coalesce(*[F.when(hit[k], F.lit(k)) for k in priority], F.lit(default))
    n = sum((hit[k].cast("int") for k in priority), F.lit(0))
    return found, n > 1, n == 0


def intents(text: Column) -> tuple[Column, Column]:
    """Whether a message follows up, and whether it wants advice (which is what a message does that does not follow up)."""
    follow = F.coalesce(F.rlike(text, F.lit(FOLLOW_UP)), F.lit(False))
    return follow, F.coalesce(F.rlike(text, F.lit(ADVICE)), F.lit(False)) | ~follow


def coordinates(text: Column) -> Column:
    """struct<lat, lon> from 'at lat, lon', any pair, or two decimals; a first match out of bounds gives null at once."""
    def number(pattern, group):
        return F.regexp_extract(text, pattern, group).try_cast("double")

    decimals = F.regexp_extract_all(text, F.lit(r"(-?\d+\.\d+)"), 1)
    at = F.rlike(text, F.lit(FARM_AT))
    pair = F.rlike(text, F.lit(PAIR))
    lat = F.when(at, number(FARM_AT, 1)).when(pair, number(PAIR, 1)).otherwise(F.get(decimals, 0).try_cast("double"))
    lon = F.when(at, number(FARM_AT, 2)).when(pair, number(PAIR, 2)).otherwise(F.get(decimals, 1).try_cast("double"))
    return F.when(lat.between(*LAT) & lon.between(*LON), F.struct(lat.alias("lat"), lon.alias("lon")))


def first_word(text: Column, listed: Sequence[str]) -> Column:
    """The first of the listed words that stands in the text as a word, capitalised."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.rlike(low, F.lit(rf"\b{w}\b")), F.lit(w.title())) for w in listed])


def longest_phrase(text: Column, phrases: Sequence[tuple[str, str]]) -> Column:
    """struct<key, confidence> of the longest phrase in the normalised text, the first of equally long ones."""
    def best(norm):
        return F.array_max(F.array_compact(F.array(*[F.when(F.contains(norm, F.lit(p)), F.struct(F.lit(len(p)).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("key"))) for i, (p, k) in enumerate(phrases)])))

    return let(let(norm_match(text), best), _found)


def _found(top: Column) -> Column:
    return F.when(top.isNotNull(), F.struct(top["key"].alias("key"), F.when(top["n"] >= 8, "high").otherwise("medium").alias("confidence")))


def family(text: Column, keywords: Sequence[tuple[str, str]], soft: Mapping[str, Sequence[str]]) -> Column:
    """struct<family, confidence>: the first keyword decides; else the most soft cues, two or more, or one without rival."""
    return let(F.lower(F.trim(text)), lambda low: _family(low, keywords, soft))


def _family(low: Column, keywords: Sequence[tuple[str, str]], soft: Mapping[str, Sequence[str]]) -> Column:
    named = F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.lit(f)) for k, f in keywords])
    counts = F.array(*[F.struct(sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(f).alias("f")) for i, (f, words) in enumerate(soft.items())])
    ranked = F.sort_array(counts, asc=False)
    first, second = ranked[0], ranked[1]["n"] if len(soft) > 1 else F.lit(0)
    return (
        F.when(named.isNotNull(), F.struct(named.alias("family"), F.lit("high").alias("confidence")))
        .when(first["n"] >= 2, F.struct(first["f"].alias("family"), F.lit("medium").alias("confidence")))
        .when((first["n"] == 1) & (second == 0), F.struct(first["f"].alias("family"), F.lit("low").alias("confidence")))
    )


#: Bytes of names that a task holds at once; a longer list is searched in parts of that size, one after another.
NAME_BYTES = 16 << 20
_HIT = "by_text boolean, phrase int, exact boolean, n int, pos long, alias string, place string"


def gazetteer(texts: DataFrame, id_col: str, text_col: str, names: DataFrame, phrases: Column | None = None) -> DataFrame:
    """id_col, alias, place for the texts that name a place in names (pos, alias, place).

    Texts and aliases are folded, in any script.  The longest alias that stands in the text counts, the first of equally
    long ones; without one, the first of `phrases` (an array of strings) that is an alias, holds one or stands in one.
    Every text is read where it lies, once for each part of the names; parts meet by id, which is to be unique.
    """
    size = names.agg(F.coalesce(F.sum(F.octet_length("alias") + F.octet_length("place") + 100), F.lit(0))).first()[0]
    parts = int(size // NAME_BYTES) + 1
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.array().cast("array<string>") if phrases is None else phrases).alias("phrases"))
    found = [_search(rows, names.filter(F.pmod(F.xxhash64("alias"), F.lit(parts)) == k)) for k in range(parts)]
    if parts > 1:
        best = F.max(F.struct("by_text", (-F.col("phrase")).alias("p"), "exact", "n", (-F.col("pos")).alias("q"), "alias", "place")).alias("b")
        return reduce(DataFrame.unionByName, found).groupBy("id").agg(best).select(F.col("id").alias(id_col), "b.alias", "b.place")
    return found[0].select(F.col("id").alias(id_col), "alias", "place")


def _search(rows: DataFrame, names: DataFrame) -> DataFrame:
    """id and _HIT of the rows (id, text, phrases) that a part of the names is found in."""
    listed = rows.sparkSession.sparkContext.broadcast([(r.pos, r.alias, r.place) for r in names.select("pos", "alias", "place").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Names(listed.value)
        for b in batches:
            hits = [held.find(t, p or ()) for t, p in zip(b.column("text").to_pylist(), b.column("phrases").to_pylist(), strict=True)]
            at = [i for i, h in enumerate(hits) if h]
            keys = [held.order[hits[i][0]] for i in at]
            columns = [
                b.column("id").take(pa.array(at, pa.int64())), pa.array([hits[i][2] < 0 for i in at], pa.bool_()), pa.array([hits[i][2] for i in at], pa.int32()), pa.array([hits[i][1] for i in at], pa.bool_()),
                pa.array([len(k) for k in keys], pa.int32()), pa.array([held.held[k][0] for k in keys], pa.int64()), pa.array(keys, pa.string()), pa.array([held.held[k][1] for k in keys], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "by_text", "phrase", "exact", "n", "pos", "alias", "place"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {_HIT}")


def place_finder(names: DataFrame, phrases: bool = True) -> Callable[[Column], Column]:
    """A function from a text to struct<place, lat, lon> of the place it names, as gazetteer() finds it, with its phrases or not.

    names: pos, alias, lat, lon.  The list is held by every task, so one above NAME_BYTES is an error: gazetteer() takes those.
    """
    size = names.agg(F.coalesce(F.sum(F.octet_length("alias") + 100), F.lit(0))).first()[0]
    if size > NAME_BYTES:
        raise ValueError(f"{size} bytes of names; gazetteer() searches lists of any length")
    listed = names.sparkSession.sparkContext.broadcast([(r.pos, r.alias, (r.lat, r.lon)) for r in names.select("pos", "alias", "lat", "lon").collect()])

    @F.pandas_udf("place string, lat double, lon double")
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        held = Names(listed.value)
        for texts, phrases in batches:
            hits = [held.find(t, p if p is not None else ()) for t, p in zip(texts, phrases, strict=True)]
            rows = [(None, None, None) if h is None else (held.order[h[0]].title(), *held.held[held.order[h[0]]][1]) for h in hits]
            yield pd.DataFrame(rows, columns=["place", "lat", "lon"]).astype({"place": object, "lat": float, "lon": float})

    def finder(text: Column) -> Column:
        return let(find(text, place_candidates(text) if phrases else F.array().cast("array<string>")), lambda x: F.when(x["place"].isNotNull(), x))

    return finder


def place_candidates(text: Column) -> Column:
    """Phrases after 'in', 'near', 'at' and the like that may name a place: cut at clause words, three letters at least."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\b(?:in|near|at|around|from)\s+([A-Za-z][A-Za-z' ]+)"), 1)
    cut = F.transform(found, lambda x: F.trim(F.get(F.split(x, r"(?i)\b(?:and|with|for|to|on|where|because|but|my|the)\b", 2), 0)))
    return F.filter(F.array_distinct(cut), lambda x: F.length(x) >= 3)


def carry_forward(turns: DataFrame, conv: str, turn: str, columns: list[str]) -> DataFrame:
    """Each turn with the latest value of every slot so far."""
    upto = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in columns})


def follow_ups(turns: DataFrame, conv: str, turn: str, text: str, recommendation: str) -> DataFrame:
    """Each turn with the last recommendation before it and the branch it takes: explain what was recommended, advise, or ask.

    A turn that follows up reuses the conversation's state; without one before it, it is a request for advice.
    """
    before = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    follow, advice = intents(F.col(text))
    prior = F.last(recommendation, ignorenulls=True).over(before)
    branch = F.when(follow & F.col("prior").isNotNull(), "explain").when(advice, "advise").otherwise("ask")
    return turns.withColumn("prior", prior).withColumn("branch", branch)


def last_turns(turns: DataFrame, conv: str, turn: str, n: int = 20) -> DataFrame:
    """The last n turns of each conversation."""
    back = Window.partitionBy(conv).orderBy(F.desc(turn))
    return turns.withColumn("_n", F.row_number().over(back)).filter(F.col("_n") <= n).drop("_n")
