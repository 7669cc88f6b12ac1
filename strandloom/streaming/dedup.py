"""Events deduplicated as their sightings arrive: state for each event key, which ends behind the watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps maps, timers and times to live; a session of such streams has to be set to it.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Set the session's state store to the one that these streams need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Sightings(StatefulProcessor):
    """One event: a map from each source to its first time, and the number of sightings so far.

    A source that is new to the event gives a row with the running number of distinct sources. The state is dropped ``keep_ms``
    after the event's last sighting, by a timer on event time; ``ttl_ms`` is a bound on wall-clock time besides.
    """

    def __init__(self, key_fields: tuple[str, ...], keep_ms: int, ttl_ms: int | None):
        self.key_fields, self.keep_ms, self.ttl_ms = key_fields, keep_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sources = handle.getMapState("sources", "source string", "first_ms long", self.ttl_ms)
        self.seen = handle.getValueState("seen", "n long, distinct long, first_ms long, last_ms long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, distinct, first, last = self.seen.get() if self.seen.exists() else (0, 0, None, None)
        before, out = last, []
        for at, source in sorted((int(t), s) for pdf in rows for s, t in zip(pdf["source"], pdf["at_ms"], strict=True)):
            if last is not None and at - last > self.keep_ms:  # the timer would have come between
                self.sources.clear()
                n, distinct, first = 0, 0, None
            n += 1
            first, last = at if first is None else min(first, at), at if last is None else max(last, at)
            if not self.sources.containsKey((source,)):
                self.sources.updateValue((source,), (at,))
                distinct += 1
                out.append((*key, source, at, distinct))
        if n:
            self.seen.update((n, distinct, first, last))
        if last is not None and last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.keep_ms)
            self.handle.registerTimer(last + self.keep_ms)
        yield pd.DataFrame(out, columns=[*self.key_fields, "source", "at_ms", "n_sources"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.sources.clear()
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def event_sightings(df: DataFrame, keys: tuple[str, ...] = ("insert_key", "context_key"), source: str = "source", ts: str = "ts", late: str = "1 hour", keep: str = "1 day", ttl_ms: int | None = None) -> DataFrame:
    """(keys, source, at, n_sources): the first sighting of an event in each source, and how many sources it has so far.

    ``df`` is a stream with the key columns (text), a source (text) and a time. The first row of an event is the
    deduplicated event itself (``n_sources = 1``); the running number is the event's accumulation curve. Sightings behind the
    watermark of ``late`` are dropped. An event that isn't seen for ``keep`` of event time is forgotten once the
    watermark is past that, so the state is as large as the events of that span; seen later, it is a new event. Rows with a null key, source
    or time are left out. In a micro batch the sightings of an event count by time, then by source.
    """
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    rows = df.select(*(F.col(c).cast("string").alias(c) for c in keys), F.col(source).cast("string").alias("source"), F.col(ts).cast("timestamp").alias("at")).dropna()
    rows = rows.withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    shape = ", ".join(f"`{c}` string" for c in keys) + ", source string, at_ms long, n_sources long"
    out = rows.groupBy(*keys).transformWithStateInPandas(Sightings(tuple(keys), keep_ms, ttl_ms), shape, "Append", "EventTime")
    return out.withColumn("at", F.timestamp_millis("at_ms")).drop("at_ms")


def event_sightings_batch(df: DataFrame, keys: tuple[str, ...] = ("insert_key", "context_key"), source: str = "source", ts: str = "ts", keep: str = "1 day") -> DataFrame:
    """The same of a table, as if it came at once in the order of its times."""
    rows = df.select(*(F.col(c).cast("string").alias(c) for c in keys), F.col(source).cast("string").alias("source"), F.col(ts).cast("timestamp").alias("at")).dropna()
    order = Window.partitionBy(*keys).orderBy("at", "source")
    away = F.unix_millis("at") - F.unix_millis(F.lag("at").over(order)) > int(pd.Timedelta(keep).total_seconds() * 1000)
    rows = rows.withColumn("_gap", F.coalesce(away.cast("int"), F.lit(0)))
    rows = rows.withColumn("_spell", F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = rows.groupBy(*keys, "_spell", "source").agg(F.min("at").alias("at"))
    run = Window.partitionBy(*keys, "_spell").orderBy("at", "source")
    return first.withColumn("n_sources", F.row_number().over(run).cast("long")).select(*keys, "source", "at", "n_sources")
