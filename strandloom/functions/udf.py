"""Arrow-batched user-defined functions over the kernels; ``register(spark)`` makes them callable from SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandloom.functions import kernels as k


class lazy:  # noqa: N801
    """A pandas UDF that is made when it is first used: workers import this module without a session."""

    def __init__(self, kind: str):
        self.kind, self.made = kind, None

    def __call__(self, *args):
        if self.made is None and len(args) == 1 and callable(args[0]):
            self.f, self.__name__, self.made = args[0], args[0].__name__, False
            return self
        return self.udf(*args)

    @property
    def udf(self):
        if not self.made:
            self.made = F.pandas_udf(self.f, self.kind)
        return self.made


def _rows(f: Callable, *cols: pd.Series) -> list:
    """``f`` of each row; null where any argument is."""
    return [None if any(x is None or x is pd.NA or x != x for x in row) else f(*row) for row in zip(*(c.tolist() for c in cols), strict=True)]


@lazy("string")
def insert_key(long: pd.Series, start: pd.Series, length: pd.Series) -> pd.Series:
    return pd.Series(_rows(lambda s, a, n: k.canonical_insert_key(s, int(a), int(n)), long, start, length), dtype=object)


@lazy("left int, right int")
def slide(long: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(_rows(lambda s, a, b: k.slide(s, int(a), int(b)), long, start, end), columns=["left", "right"], dtype=object)


@lazy("lcp int, lcs int, insert string, overlap int")
def decompose(short: pd.Series, long: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([x or {} for x in _rows(k.decompose, short, long)], columns=["lcp", "lcs", "insert", "overlap"], dtype=object)


@lazy("tsd_len int, tsd_seq string, side string, confidence string")
def tsd(insert: pd.Series, left: pd.Series, right: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([x or {} for x in _rows(k.duplication, insert, left, right)], columns=["tsd_len", "tsd_seq", "side", "confidence"], dtype=object)


@lazy("int")
def outward_repeat(s: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_rows(lambda x, i, j: k.outward_repeat(x, int(i), int(j)), s, a, b), dtype="Int32")


@lazy("int")
def inverted_repeat(s: pd.Series) -> pd.Series:
    return pd.Series(_rows(k.inverted_repeat, s), dtype="Int32")


@lazy("int")
def project_boundary(cigar: pd.Series, q_start: pd.Series, t_start: pd.Series, boundary: pd.Series) -> pd.Series:
    return pd.Series(_rows(lambda c, q, t, b: k.project_boundary(c, int(q), int(t), int(b)), cigar, q_start, t_start, boundary), dtype="Int32")


@lazy("ok boolean, coverage double, identity double, insert_len int, lcp int, insert_start int, second int, lost int, ambiguity int")
def tolerant_decompose(short: pd.Series, long: pd.Series) -> pd.DataFrame:
    cols = ["ok", "coverage", "identity", "insert_len", "lcp", "insert_start", "second", "lost", "ambiguity"]
    return pd.DataFrame([x or {} for x in _rows(k.tolerant_decompose, short, long)], columns=cols, dtype=object)


@lazy("identity double, coverage double, score double, orientation string")
def best_orientation(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([x or {} for x in _rows(k.best_orientation, a, b)], columns=["identity", "coverage", "score", "orientation"], dtype=object)


@lazy("start int, status string")
def locate_insert(long: pd.Series, length: pd.Series, start: pd.Series, lcp: pd.Series, md5: pd.Series) -> pd.DataFrame:
    def one(s, n, a, p, h):
        whole = lambda x: None if x is None or x != x else int(x)
        return (None, "unresolved") if s is None or whole(n) is None else k.locate_insert(s, int(n), whole(a), whole(p), h)

    return pd.DataFrame([one(*r) for r in zip(*(c.tolist() for c in (long, length, start, lcp, md5)), strict=True)], columns=["start", "status"], dtype=object)


@lazy("array<struct<start:int,end:int,strand:string,aa:int>>")
def orf_scan(s: pd.Series) -> pd.Series:
    return pd.Series(_rows(k.open_reading_frames, s), dtype=object)


@lazy("string")
def dominant_protein(s: pd.Series) -> pd.Series:
    return pd.Series(_rows(k.dominant_protein, s), dtype=object)


@lazy("string")
def translate_codons(s: pd.Series) -> pd.Series:  # not ``translate``, which SQL has
    return pd.Series(_rows(k.translate, s), dtype=object)


@lazy("status string, gap int, coverage double, identity double, left int, right int, start_shift int, end_shift int")
def compare_alleles(long: pd.Series, short: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
    cols = ["status", "gap", "coverage", "identity", "left", "right", "start_shift", "end_shift"]
    return pd.DataFrame([x or {} for x in _rows(lambda x, y, a, b: k.compare_alleles(x, y, int(a), int(b)), long, short, start, end)], columns=cols, dtype=object)


@lazy("long")
def count_kmers(s: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series(_rows(lambda x, n: k.count_kmers(x, int(n)), s, size), dtype="Int64")


@lazy("string")
def fixed(x: pd.Series, digits: pd.Series) -> pd.Series:
    return pd.Series([k.fixed(v, int(n)) for v, n in zip(x.tolist(), digits.tolist(), strict=True)], dtype=object)


FUNCTIONS = {f.__name__: f for f in (insert_key, slide, decompose, tsd, outward_repeat, inverted_repeat, project_boundary, tolerant_decompose, best_orientation, locate_insert, orf_scan, dominant_protein, translate_codons, compare_alleles, count_kmers, fixed)}


def register(spark: SparkSession) -> None:
    """Register every function under its own name, table functions and the aggregate too."""
    from strandloom.functions import udtf

    for name, f in FUNCTIONS.items():
        if name != "orf_scan":  # the table function has this name in SQL
            spark.udf.register(name, f.udf)
    spark.udf.register("orf_array", orf_scan.udf)
    udtf.register(spark)
