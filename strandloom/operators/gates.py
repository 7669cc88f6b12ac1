"""Checks that stop a run or are reported beside its result: join rates, collisions, decision gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GateError(RuntimeError):
    """A check failed; ``code`` is the exit code of a job that stops at it."""

    def __init__(self, message: str, code: int = 2):
        super().__init__(message)
        self.code = code


def join_rate(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """(matched, total, rate) of the left rows that have a partner; one pass with a semi-join's worth of keys."""
    keys = right.select(*on).distinct().withColumn("_hit", F.lit(1))
    out = left.join(keys, on, "left").agg(F.count("_hit").alias("matched"), F.count("*").alias("total"))
    return out.withColumn("rate", F.when(F.col("total") > 0, F.col("matched") / F.col("total")))


def assert_join_rate(left: DataFrame, right: DataFrame, on: list[str], floor: float = 0.5) -> tuple[int, int]:
    """Matched and total; raises below ``floor``, and for an empty left side: an empty result is a failure."""
    r = join_rate(left, right, on).first()
    if not r["total"] or r["rate"] < floor:
        raise GateError(f"{r['matched']} of {r['total']} rows have a partner; at least {floor:.0%} are asked for")
    return r["matched"], r["total"]


def assert_no_collision(df: DataFrame, key: list[str]) -> None:
    """Raises if a key occurs more than once."""
    twice = df.groupBy(*key).count().where("count > 1").limit(5).collect()
    if twice:
        raise GateError(f"keys occur more than once: {[tuple(r)[:-1] for r in twice]}")


def evaluate_gates(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """``gates`` (metric, op, threshold) against ``metrics`` (metric, value): one row per gate with ``passed``; a metric
    that is missing fails."""
    v, t = F.col("value"), F.col("threshold")
    ok = F.when(F.col("op") == "==", v == t).when(F.col("op") == ">=", v >= t).when(F.col("op") == "<=", v <= t).when(F.col("op") == ">", v > t).when(F.col("op") == "<", v < t)
    return gates.join(metrics, "metric", "left").withColumn("passed", F.coalesce(ok, F.lit(False)))
