"""Streams of timed rows: sessions, windows, and events deduplicated by key as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def timed(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def sessions(df: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Session windows: the image of merging intervals with a slack, on time."""
    w = timed(df, ts).withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def tumbling(df: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts by tumbling, or with ``slide`` sliding, windows."""
    return timed(df, ts).withWatermark(ts, late).groupBy(F.window(ts, width, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), "n")


def first_of_each(df: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Rows whose key hasn't been seen within the watermark; state is dropped behind it."""
    return timed(df, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def distinct_loci(df: DataFrame, key: str, ts: str = "ts", separation: float = 3600.0, late: str = "1 day") -> DataFrame:
    """(key, n): greedy thinning of a stream by a stateful fold: a row counts if it is ``separation`` after the last one
    that counted. The state is one time and one count for each key."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def fold(name, batches, state):
        last, n = state.get if state.exists else (None, 0)
        for pdf in batches:
            for t in sorted(pdf["t"]):
                if last is None or t - last >= separation:
                    last, n = float(t), n + 1
        state.update((last, n))
        yield pd.DataFrame({key: [name[0]], "n": [n]})

    rows = timed(df, ts).withWatermark(ts, late).select(F.col(key), F.col(ts).cast("double").alias("t"))
    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(fold, f"`{key}` {kind}, n long", "last double, n long", "update", GroupStateTimeout.NoTimeout)
