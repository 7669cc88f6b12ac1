"""What a run leaves behind whether or not it ends well: an empty folder to begin with, a log of its stages, a summary."""

from __future__ import annotations

import datetime
import html
import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.gates import GateError


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def expand(spark: SparkSession, patterns: list[str]) -> list[str]:
    """SC10: the files of the patterns, one pattern after the other, each one's in order of their names, none twice.

    What has no ``*``, ``?`` or ``[`` is taken as it is, whether it exists or not; a pattern without a match gives nothing. Works
    in any store that Spark reads.
    """
    out: dict[str, None] = {}
    for p in patterns:
        if not any(c in p for c in "*?["):
            out[p] = None
            continue
        where, fs = _path(spark, p)
        for name in sorted(s.getPath().toString() for s in fs.globStatus(where) or ()):
            out[name.removeprefix("file:") if not p.startswith("file:") else name] = None
    return list(out)


def require_empty(spark: SparkSession, path: str) -> None:
    """SK7: fail unless the folder is missing or empty, so that results of two runs never mix."""
    where, fs = _path(spark, path)
    if fs.exists(where) and (fs.getFileStatus(where).isFile() or len(fs.listStatus(where))):
        raise GateError(f"{path} exists and isn't an empty folder")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, replaced if it is there, in any store."""
    where, fs = _path(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def file_sizes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length) of the files of a list, from the store's own status (Spark's readers pass over empty files); null length
    where there is none."""
    rows = []
    for p in paths:
        where, fs = _path(spark, p)
        rows.append((p, fs.getFileStatus(where).getLen() if fs.exists(where) else None))
    return spark.createDataFrame(rows, "path string, length long")


#: Endings of sequence files that don't belong to their names. Fixed values.
ENDINGS = (".fna.gz", ".fa.gz", ".fasta.gz", ".fna", ".fa", ".fasta")


def manifest_problems(files: DataFrame) -> DataFrame:
    """SC23: (path, problem) of a table of files (path, length), one row for each rule that a file breaks.

    missing; compressed; empty; duplicate_name (another path with the same name without its ending); duplicate_file. A table of fewer than
    two distinct files has one row more, ``too_few_files`` without a path.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    stem = name
    for e in reversed(ENDINGS):
        stem = F.when(F.endswith(name, F.lit(e)), F.substring(name, F.lit(1), F.length(name) - len(e))).otherwise(stem)
    rows = files.groupBy("path").agg(F.count("*").alias("times"), F.max("length").alias("length")).withColumn("stem", stem)
    names = rows.groupBy("stem").agg(F.count("*").alias("paths"))
    rows = rows.join(names, "stem")
    tests = (F.col("length").isNull(), "missing"), (F.endswith("path", F.lit(".gz")), "compressed"), (F.col("length") == 0, "empty"), (F.col("paths") > 1, "duplicate_name"), (F.col("times") > 1, "duplicate_file")
    found = rows.select("path", F.explode(F.array_compact(F.array(*(F.when(t, F.lit(n)) for t, n in tests)))).alias("problem"))
    few = rows.agg(F.count("*").alias("n")).where("n < 2").select(F.lit(None).cast("string").alias("path"), F.lit("too_few_files").alias("problem"))
    return found.unionByName(few)


def assert_manifest(files: DataFrame, shown: int = 20) -> None:
    """Fail with the first problems of a manifest."""
    bad = manifest_problems(files).orderBy("problem", "path").limit(shown).collect()
    if bad:
        raise GateError("; ".join(f"{r['problem']}: {r['path']}" for r in bad))


class RunLog:
    """SK6: the state of a run in ``<folder>/summary.json`` and ``<folder>/stages``, saved before and after every stage.

    A failure leaves both as they were when it came, with the status ``failed`` and the error; a failure of a stage that is
    only supplementary keeps the primary status. ``stages`` is a table (no, stage, status, at, seconds, detail) of JSON files.
    """

    def __init__(self, spark: SparkSession, folder: str, **about):
        require_empty(spark, folder)
        self.spark, self.folder, self.no = spark, folder.rstrip("/"), 0
        self.summary = {"primary_status": "running", "supplementary_status": "not_requested"} | about
        self.save()

    def save(self) -> None:
        write_text(self.spark, f"{self.folder}/summary.json", json.dumps(self.summary, indent=2, default=str))

    def _row(self, stage: str, status: str, began: datetime.datetime, detail: str = "") -> None:
        now = datetime.datetime.now(datetime.timezone.utc)
        row = {"no": self.no, "stage": stage, "status": status, "at": now.isoformat(), "seconds": (now - began).total_seconds(), "detail": detail}
        write_text(self.spark, f"{self.folder}/stages/{self.no:04d}-{status}.json", json.dumps(row) + "\n")

    @contextmanager
    def stage(self, name: str, supplementary: bool = False, **detail) -> Iterator[dict]:
        """A stage; what is put into the dictionary that it yields goes to the summary."""
        began, found = datetime.datetime.now(datetime.timezone.utc), {}
        self.no += 1
        if supplementary:
            self.summary["supplementary_status"] = "running"
        self._row(name, "running", began, json.dumps(detail, default=str))
        self.save()
        try:
            yield found
        except Exception as e:
            self.summary["error"] = f"{name}: {e}"[:2000]
            self.summary["supplementary_status" if supplementary else "primary_status"] = "failed"
            self._row(name, "failed", began, str(e)[:2000])
            self.save()
            raise
        self.summary |= found
        if supplementary:
            self.summary["supplementary_status"] = "complete"
        self._row(name, "complete", began, json.dumps(found, default=str))
        self.save()

    def complete(self) -> None:
        self.summary["primary_status"] = "complete"
        self.save()

    def table(self) -> DataFrame:
        """The stages so far; the last row of a stage is its state."""
        return self.spark.read.schema("no int, stage string, status string, at string, seconds double, detail string").json(f"{self.folder}/stages")


def write_report(spark: SparkSession, folder: str, title: str, table: DataFrame, summary: dict, most: int = 1000) -> None:
    """SK5: ``report.html``, with the summary and the first ``most`` rows, escaped, and ``summary.json``."""
    from strandloom.sources.writers import report

    told = json.dumps(summary, indent=2, default=str)
    write_text(spark, f"{folder}/summary.json", told)
    page = f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><pre>{html.escape(told)}</pre>{report(table, title, most)}'
    write_text(spark, f"{folder}/report.html", page)


def status_counts(df: DataFrame, *columns: str) -> dict[str, dict[str, int]]:
    """How often each value of a few status columns occurs, for a summary."""
    out: dict[str, dict[str, int]] = {}
    for c in columns:
        out[c] = {str(r[c]): r["count"] for r in df.groupBy(c).count().orderBy(c).collect()}
    return out
