"""Containment join: which texts hold which items, and where."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import spread

#: Characters of items that one broadcast may have; more are joined in that many parts.
PART_CHARS = 4_000_000


def containment_join(texts: DataFrame, items: DataFrame, text: str = "text", item: str = "item_text", most_chars: int = PART_CHARS) -> DataFrame:
    """All pairs where ``item`` occurs in ``text``, with ``at`` (0-based first occurrence).

    Substring containment has no equality to hash on. The items' size is measured first; they are broadcast in parts of at
    most ``most_chars``, so a task never holds more of them, and each part streams the texts once.
    """
    size = items.agg(F.coalesce(F.sum(F.length(item)), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-size // most_chars))
    split, texts = items.where(F.length(item) > 0), spread(texts)
    found = []
    for k in range(parts):
        part = split if parts == 1 else split.where(F.pmod(F.xxhash64(item), F.lit(parts)) == k)
        found.append(texts.join(F.broadcast(part), F.contains(F.col(text), F.col(item))))
    return reduce(DataFrame.unionByName, found).withColumn("at", F.expr(f"cast(locate(`{item}`, `{text}`) - 1 as long)"))
