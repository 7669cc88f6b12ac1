"""Sinks. A folder that isn't empty is refused, so that results of two runs never mix; an empty one is fine."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.sources.runs import require_empty


def _fresh(df: DataFrame, path: str):
    """A writer to a folder that is missing or empty."""
    require_empty(df.sparkSession, path)
    return df.write.mode("append")


def fasta_record(name: Column, seq: Column, width: int = 80) -> Column:
    """SK1: a wrapped record without its last line end."""
    return F.concat(F.lit(">"), name, F.lit("\n"), F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", ""))


def write_fasta(df: DataFrame, path: str, name: str = "contig", seq: str = "seq", width: int = 80) -> None:
    _fresh(df.select(fasta_record(F.col(name), F.col(seq), width)), path).text(path)


def write_tsv(df: DataFrame, path: str, columns: list[str], one_file: bool = False) -> None:
    """SK2: named columns in order; the header is there for an empty table too."""
    out = df.select(*columns)
    out = out.coalesce(1) if one_file or out.isEmpty() else out
    _fresh(out, path).option("sep", "\t").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """SK3."""
    _fresh(df, path).json(path)


def params(df: DataFrame) -> DataFrame:
    """SK4: a one-row table as (key, value)."""
    cols = F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in df.columns))
    return df.select(F.inline(cols))


def report(df: DataFrame, title: str, most: int = 1000) -> str:
    """SK5: an HTML table of a small result, escaped; it says so where there are more than ``most`` rows."""
    rows = df.limit(most + 1).collect()
    more = f"<p>More than {most} rows; the first {most} are shown.</p>" if len(rows) > most else ""
    rows = rows[:most]
    cell = lambda tag, v: f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>"
    body = "".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in rows)
    return f"<h1>{html.escape(title)}</h1><table><tr>{''.join(cell('th', c) for c in df.columns)}</tr>{body}</table>{more}"


def write_fan_out(df: DataFrame, path: str, keys: list[str], value: str) -> None:
    """SK8: one folder of text files for each key."""
    _fresh(df.select(*keys, F.col(value).cast("string").alias("value")), path).partitionBy(*keys).text(path)
