"""State of streams that ends, and slots with memory, against their batch versions and literal conversations."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from siltstone.operators import classify, slots
from siltstone.streaming import events, state

EVENTS = "u long, e long, ts timestamp"
T0 = datetime(2024, 1, 1)


def run(df, name, tmp_path, **trigger):
    query = df.writeStream.format("parquet").option("path", str(tmp_path / name)).trigger(**trigger or {"availableNow": True}).option("checkpointLocation", str(tmp_path / f"checkpoint-{name}")).start()
    try:
        assert query.awaitTermination(90)
    finally:
        query.stop()
    return query


def held(query):
    """Rows of state after the last batch."""
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_limits_over_batches_equal_those_of_a_batch(spark, tmp_path):
    rows = [(u, u * 1000 + i, T0 + timedelta(seconds=s * (1 + u))) for u in (1, 2, 3) for i, s in enumerate((0, 5, 10, 20, 31, 33, 61, 62, 63, 90))]
    df = spark.createDataFrame(rows, EVENTS)
    want = {(r.e, r.allowed) for r in events.rate_limit(df, "u", "e", "ts", 60, 2).collect()}
    at = tmp_path / "in"
    df.filter("ts < '2024-01-01 00:01:00'").coalesce(1).write.mode("append").parquet(str(at))
    source = lambda: spark.readStream.schema(df.schema).parquet(str(at))
    run(state.limit_rate(source(), "u", "e", "ts", 60, 2), "limited", tmp_path)
    df.filter("ts >= '2024-01-01 00:01:00'").coalesce(1).write.mode("append").parquet(str(at))
    run(state.limit_rate(source(), "u", "e", "ts", 60, 2), "limited", tmp_path)  # started again on the same checkpoint
    got = {(r.e, r.allowed) for r in spark.read.parquet(str(tmp_path / "limited")).collect()}
    assert got == want and len(got) == len(rows)


def test_clients_that_stay_away_have_no_state(spark, tmp_path):
    at = str(tmp_path / "in")
    df = spark.createDataFrame([(u, u, T0) for u in range(40)], EVENTS)
    df.coalesce(1).write.mode("append").parquet(at)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(at)
    query = run(state.limit_rate(source, "u", "e", "ts", 60, 2, "1 minute"), "idle_one", tmp_path)
    before = held(query)
    spark.createDataFrame([(99, 99, T0 + timedelta(hours=2))], EVENTS).coalesce(1).write.mode("append").parquet(at)
    after = run(state.limit_rate(source, "u", "e", "ts", 60, 2, "1 minute"), "idle_one", tmp_path)
    assert before >= 40 > held(after)


SAID = [
    (1, 0, "user", "My challenge is Crop production and management", None),
    (1, 1, "assistant", "Try terraces", (slots.EROSION, "soil loss", 9.0, 38.0, "Teff")),
    (1, 2, "user", "and now?", None),
    (1, 3, "user", "farm at 10.5, 39.5 with maize against runoff", None),
    (1, 4, "assistant", "no place", ("Unknown family", "unknown", None, 38.0, "")),
    (1, 5, "user", "more", None),
    (2, 0, "user", "I want more income near Debre Markos", None),
    (2, 1, "user", "My challenge is Livestock production and management", None),
    (3, 0, "user", "stop runoff on the steep slope", None),
    (3, 2, "user", None, None),
    (4, 0, "system", "erosion", None),
]
SCHEMA = f"c long, n long, role string, t string, given {slots.PRIOR}"
PAIRS = [(slots.EROSION, "soil loss"), (slots.EROSION, "runoff"), (slots.CROP, "income"), (slots.CROP, "yield"), (slots.FERTILITY, "SOM content")]
NAMES = [(1, "debre markos", 10.33, 37.72), (2, "debre", 11.0, 39.0)]


def told(spark):
    return spark.createDataFrame(SAID, SCHEMA), classify.place_finder(spark.createDataFrame(NAMES, "pos int, alias string, lat double, lon double"))


def by_turn(rows):
    return {(r.c, r.n): r for r in rows}


def test_slots_with_memory(spark):
    turns, place = told(spark)
    got = by_turn(slots.conversation_slots(turns, "c", "n", "t", user=F.col("role") == "user", prior=F.col("given"), supported=PAIRS, place=place).collect())
    assert set(got) == {(1, 0), (1, 2), (1, 3), (1, 5), (2, 0), (2, 1), (3, 0), (3, 2)}
    first, second, third, last = (got[1, n] for n in (0, 2, 3, 5))
    assert (first.family, first.family_by, first.indicator, first.missing, first.complete) == (slots.CROP, "high", None, ["objective", "location"], False)
    assert (second.family, second.family_by, second.indicator, second.indicator_by, second.lat, second.location_by, second.crop, second.complete) == (slots.EROSION, "prior", "soil loss", "prior", 9.0, "prior", "Teff", True)
    assert (third.family, third.indicator, third.indicator_by, third.lat, third.lon, third.location_by, third.crop) == (slots.EROSION, "runoff", "medium", 10.5, 39.5, "high", "Maize")
    # the last recommendation names nothing that is known, so all messages together decide
    assert (last.family, last.indicator, last.lat, last.crop) == (slots.CROP, None, 10.5, "Maize")
    income, livestock = got[2, 0], got[2, 1]
    assert (income.family, income.family_by, income.indicator, income.place, income.lat, income.inferred) == (slots.CROP, "inferred", "income", "Debre Markos", 10.33, ["location", "practice_family"])
    assert (livestock.family, livestock.indicator, livestock.missing) == (slots.LIVESTOCK, None, ["objective"])
    assert (got[3, 0].family, got[3, 0].indicator) == (slots.EROSION, "runoff")
    assert got[3, 2].family == slots.EROSION and got[3, 2].missing == ["location"]


def test_an_unsupported_family_gives_way_to_a_stronger_objective(spark):
    rows = spark.createDataFrame([(1, 0, "My objective is to increase income on land with cattle"), (2, 0, "income and cattle and goats"), (3, 0, "My objective is to reduce runoff for livestock")], "c long, n long, t string")
    got = by_turn(slots.conversation_slots(rows, "c", "n", "t", supported=PAIRS).collect())
    assert (got[1, 0].family, got[1, 0].family_by, got[1, 0].indicator) == (slots.CROP, "inferred", "income")
    assert (got[2, 0].family, got[2, 0].indicator) == (slots.LIVESTOCK, None)
    assert (got[3, 0].family, got[3, 0].indicator) == (slots.LIVESTOCK, None)
    none = by_turn(slots.conversation_slots(rows, "c", "n", "t", supported=[]).collect())
    assert none[1, 0].family is None and none[1, 0].indicator == "income"


def test_pairs_of_an_evidence_table(spark):
    rows = spark.createDataFrame([(slots.CROP, "yield"), (slots.CROP, "yield"), ("other", "yield"), (slots.CROP, "other"), (None, None)], "f string, i string")
    assert slots.supported_pairs(rows, "f", "i") == [(slots.CROP, "yield")]


def test_a_stream_remembers_as_a_batch_does(spark, tmp_path):
    turns, place = told(spark)
    user = F.col("role") == "user"
    want = by_turn(slots.conversation_slots(turns, "c", "n", "t", 2, user, F.col("given"), PAIRS, place).collect())
    at = str(tmp_path / "in")
    for low, high in ((0, 2), (3, 9)):  # two runs on one checkpoint
        turns.filter(F.col("n").between(low, high)).coalesce(1).write.mode("append").parquet(at)
        source = spark.readStream.schema(turns.schema).parquet(at)
        kept = state.remember(source, "c", "n", "t", user, F.col("given"), 2)
        run(slots.read_slots(kept, PAIRS, place), "out", tmp_path, once=True)  # state by processing time goes on without new data
    got = by_turn(spark.read.parquet(str(tmp_path / "out")).collect())
    assert {k: r.asDict() for k, r in got.items()} == {k: r.asDict() for k, r in want.items()}


def test_conversations_left_alone_are_forgotten(spark, tmp_path):
    import time

    at = str(tmp_path / "in")
    turns, _ = told(spark)
    turns.filter("c = 1 and n < 2").coalesce(1).write.mode("append").parquet(at)
    source = spark.readStream.schema(turns.schema).parquet(at)
    kept = lambda: state.remember(source, "c", "n", "t", F.col("role") == "user", F.col("given"), 20, 1)
    run(kept(), "gone", tmp_path, once=True)
    time.sleep(1.5)
    turns.filter("c = 1 and n = 2").coalesce(1).write.mode("append").parquet(at)
    run(kept(), "gone", tmp_path, once=True)
    assert [(r.n, r.whole, r.prior) for r in spark.read.parquet(str(tmp_path / "gone")).orderBy("n").collect()][-1] == (2, "and now?", None)
