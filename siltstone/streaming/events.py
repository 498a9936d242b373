"""Event streams: chat turns to ordered events and back, rate limits with state, windows with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chat_events(turns: DataFrame, keys: list[str], slots: Column, recommendation: Column, tokens: Column) -> DataFrame:
    """keys, seq, event, data: a turn's slots, its recommendation if any, its text piece by piece, and done."""
    event = lambda name, data: F.struct(F.lit(name).alias("event"), data.alias("data"))
    some = F.when(recommendation.isNotNull(), F.array(event("recommendation", recommendation))).otherwise(F.array().cast("array<struct<event:string,data:string>>"))
    whole = F.concat(F.array(event("slots", slots)), some, F.transform(tokens, lambda t: F.struct(F.lit("token").alias("event"), t.alias("data"))), F.array(event("done", F.lit(""))))
    return turns.select(*keys, F.posexplode(whole).alias("seq", "e")).select(*keys, F.col("seq").cast("long").alias("seq"), "e.event", "e.data")


def fold(events: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each stream: its text, its last recommendation and slots, its error."""
    last = lambda name: F.max_by(F.when(F.col("event") == name, F.col("data")), F.when(F.col("event") == name, F.col("seq")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("event") == "token", F.struct("seq", "data")))), lambda x: x["data"]), "")
    return events.groupBy(*keys).agg(text.alias("text"), last("slots").alias("slots"), last("recommendation").alias("recommendation"), last("error").alias("error"))


def parse_sse(lines: DataFrame, column: str) -> DataFrame:
    """event, data of the blocks in a stream's text; blocks without data are skipped."""
    blocks = lines.select(F.posexplode(F.split(column, r"\n\n")).alias("seq", "block"))
    field = lambda name: F.nullif(F.regexp_extract("block", rf"(?m)^{name}:\s?(.*)$", 1), F.lit(""))
    return blocks.select(F.col("seq").cast("long").alias("seq"), F.coalesce(field("event"), F.lit("message")).alias("event"), field("data").alias("data")).filter("data is not null")


def limited(times: list[int], kept: list[int], span: int, limit: int) -> tuple[list[bool], list[int]]:
    """Which of the times, in order, are let through; those that are not do not count."""
    out = []
    for t in times:
        kept = [k for k in kept if k > t - span]
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out, kept


def rate_limit(events: DataFrame, client: str, event_id: str, time: str, span_s: int, limit: int) -> DataFrame:
    """client, event_id, allowed for a batch: a sliding window over the events let through.

    A client's events are taken as a stream of Arrow batches in order of time, with the times let through as the only
    state, at most `limit` of them, so a client's history of any length fits.
    """
    span = span_s * 1_000_000
    rows = events.select(F.col(client).alias("c"), F.col(event_id).alias("e"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, kept = None, []
        for batch in batches:
            out = []
            for c, t in zip(batch["c"], batch["t"], strict=True):
                if c != at:
                    at, kept = c, []
                (ok,), kept = limited([t], kept, span, limit)
                out.append(ok)
            yield pd.DataFrame({"c": batch["c"], "e": batch["e"], "allowed": out})

    ordered = rows.repartition("c").sortWithinPartitions("c", "t", "e")
    return ordered.mapInPandas(run, "c long, e long, allowed boolean").toDF(client, event_id, "allowed")


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], value: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums by window, for batches and streams."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    found = rows.groupBy(F.window("_t", width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 6).alias("total"))
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, time: str, width: str, step: str, keys: list[str]) -> DataFrame:
    rows = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", "1 hour")
    found = rows.groupBy(F.window("_t", width, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("start"), *keys, "n")


def sessions(events: DataFrame, time: str, gap: str, key: str) -> DataFrame:
    """key, start, n of runs of events no further apart than the gap."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", "1 hour")
    found = rows.groupBy(F.session_window("_t", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return found.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def latencies(spark, query) -> DataFrame:
    """batch_id, n_rows, took_ms of a streaming query's batches, as its progress reports them."""
    rows = [(p["batchId"], p["numInputRows"], p["durationMs"].get("triggerExecution", 0)) for p in query.recentProgress]
    return spark.createDataFrame(rows, "batch_id long, n_rows long, took_ms long")


def latest_user_turn(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The most recent user turn of each conversation."""
    return turns.filter(F.col(role) == "user").groupBy(conv).agg(F.max(turn).alias(turn), F.max_by(text, turn).alias(text))
