"""State that ends: a rate limiter with event-time timers and a conversation's memory with a time to live.

Both run on transformWithStateInPandas, which needs the RocksDB state store; stateful() sets it for the session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltstone.streaming.events import limited

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> None:
    """Let the session's streams that start from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


class _Limiter(StatefulProcessor):
    """The times that were let through, at most `limit` of them, until the watermark passes the last one's span."""

    def __init__(self, span: int, limit: int) -> None:
        self.span, self.limit = span, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["t", "e"])
        allowed, kept = limited(new["t"].tolist(), [t for (t,) in self.times.get()], self.span, self.limit)
        if kept:  # the store takes no empty list; none is kept if the limit is 0
            self.times.put([(t,) for t in kept])
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer((kept[-1] + self.span) // 1000 + 1)
        yield pd.DataFrame({"c": new["c"], "e": new["e"], "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        yield pd.DataFrame({"c": pd.Series([], dtype="int64"), "e": pd.Series([], dtype="int64"), "allowed": pd.Series([], dtype="bool")})

    def close(self) -> None:
        pass


def limit_rate(events: DataFrame, client: str, event_id: str, time: str, span_s: int, limit: int, late: str = "10 minutes") -> DataFrame:
    """client, event_id, allowed of a stream: a sliding window over the events let through; refused ones are not kept.

    Events are in order within a batch and no older than `late` between batches, or they are dropped.  A client whose
    last event let through is out of the span by the watermark has no state any more.
    """
    stateful(events.sparkSession)
    at = F.col(time).cast("timestamp")
    rows = events.select(F.col(client).cast("long").alias("c"), F.col(event_id).cast("long").alias("e"), F.unix_micros(at).alias("t"), at.alias("at")).withWatermark("at", late)
    out = rows.groupBy("c").transformWithStateInPandas(_Limiter(span_s * 1_000_000, limit), "c long, e long, allowed boolean", "Append", "EventTime")
    return out.toDF(client, event_id, "allowed")


class _Memory(StatefulProcessor):
    """The last messages of a conversation's user and what was recommended last."""

    def __init__(self, most: int, ttl_ms: int) -> None:
        self.most, self.ttl = most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.said = handle.getListState("said", "text string", self.ttl)
        self.prior = handle.getValueState("prior", "record string", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("turn")
        said = [t for (t,) in self.said.get()]
        prior = self.prior.get()[0] if self.prior.exists() else None
        out = []
        for turn, user, text, record in zip(new["turn"], new["user"], new["own"], new["record"], strict=True):
            if user:
                said = [*said, text][-self.most :]
                out.append((key[0], turn, text, "\n".join(said), prior))
            if record is not None and not pd.isna(record):
                prior = record
        if said:  # the store takes no empty list
            self.said.put([(t,) for t in said])
        if prior is not None:
            self.prior.update((prior,))
        yield pd.DataFrame(out, columns=["conv", "turn", "own", "whole", "record"])

    def close(self) -> None:
        pass


def remember(turns: DataFrame, conv: str, turn: str, text: str, user: Column, prior: Column, most: int = 20, ttl_s: int = 30 * 86_400) -> DataFrame:
    """conv, turn, own, whole, prior for each message of a user in a stream, as slots.read_slots() takes them.

    whole: the last `most` messages together; prior: the struct that was recommended last before the message, null if
    nothing was.  A conversation that is left alone for ttl_s seconds is forgotten; state by processing time makes Spark plan
    batches without end, so such a query runs until it is stopped, or for one batch at a time.
    """
    stateful(turns.sparkSession)
    rows = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(user, F.lit(False)).alias("user"), F.coalesce(F.col(text), F.lit("")).alias("own"), F.to_json(prior).alias("record"))
    kept = rows.groupBy("conv").transformWithStateInPandas(_Memory(most, ttl_s * 1000), "conv long, turn long, own string, whole string, record string", "Append", "ProcessingTime")
    kind = turns.select(prior.alias("prior")).schema["prior"].dataType
    return kept.select(F.col("conv").alias(conv), F.col("turn").alias(turn), "own", "whole", F.from_json("record", kind).alias("prior"))
