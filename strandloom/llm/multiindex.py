"""Approximate nearest neighbours by an inverted multi-index: two halves of a vector are quantised on their own, and a query
opens the pairs of their centroids in the order of their summed nearness."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import bounded_batches, count_table, cut, drawn
from strandloom.llm.vectors import usable
from strandloom.operators.joins import heavy_split_join
from strandloom.session import materialize, scratch

#: Distinct vectors of one length that the centroids are fitted on, how many of them each centroid has at least on average, and
#: the rounds of the fit. So a half never has more than ``SAMPLE // PER_CENTROID`` centroids.
SAMPLE, PER_CENTROID, ROUNDS, SEED = 16384, 16, 8, 7
#: Distinct vectors that a cell (a pair of centroids) has on average, up to that many centroids.
CELL = 16
#: Entries that a query ranks before it knows how near its k-th neighbour is, and how many deviations of a cell's entries
#: below that its centroids may lie for the cell to be opened afterwards.
FIRST, SIGMAS = 1024, 3.25
#: Entries of a shard (a run of cells), and queries of a task.
SHARD, QUERIES = 8192, 2048


# -- the two codebooks ------------------------------------------------------------------------------------------------


def fit_half(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """``k`` centroids of half vectors by Lloyd's rounds, and the variance of the entries around each, a component.

    The variance of a centroid with few rows is drawn towards that of all, as if it had four rows more.
    """
    at = np.random.default_rng(SEED).choice(len(rows), k, replace=False)
    c = rows[np.sort(at)].copy()
    for turn in range(rounds + 1):
        to = assign_half(rows, c)
        n = np.bincount(to, minlength=k)
        if turn == rounds:
            break
        for d in range(rows.shape[1]):
            total = np.bincount(to, rows[:, d], k)
            c[n > 0, d] = total[n > 0] / n[n > 0]
    off = ((rows - c[to]) ** 2).mean(axis=1) if rows.shape[1] else np.zeros(len(rows))
    return c, (np.bincount(to, off, k) + 4 * off.mean()) / (n + 4)


def assign_half(rows: np.ndarray, c: np.ndarray, step: int = 4096) -> np.ndarray:
    """The nearest centroid of each half vector; the smaller number of two as near."""
    size = (c * c).sum(axis=1)
    parts = [np.nan_to_num(size - 2 * (rows[k : k + step] @ c.T), nan=np.inf).argmin(axis=1) for k in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class Codebook:
    """Centroids of both halves of the vectors of one length; cell ``base + i * k + j`` is a pair of them."""

    def __init__(self, dim: int, base: int, k: int, scale: float, data: tuple[np.ndarray, ...]):
        self.dim, self.base, self.k, self.scale = dim, base, k, scale
        self.cut = -(-dim // 2)
        self.one, self.var_one, self.two, self.var_two = data

    def cells(self, rows: np.ndarray) -> np.ndarray:
        rows = rows / self.scale
        return self.base + assign_half(rows[:, : self.cut], self.one) * self.k + assign_half(rows[:, self.cut :], self.two)

    def traverse(self, q: np.ndarray, counts: np.ndarray):
        """The non-empty cells as (cell, summed product with both centroids, deviation of its entries), the nearest first.

        The products of the query's halves with the centroids are sorted; a heap holds, for each row of the table of their
        sums that has been reached, its best pair that is still open. So no pair is looked at before its turn.
        """
        with np.errstate(all="ignore"):
            a, b = q[: self.cut] / self.scale, q[self.cut :] / self.scale
            near_a, near_b = np.nan_to_num(self.one @ a), np.nan_to_num(self.two @ b)
            var_a, var_b = np.nan_to_num(self.var_one * (a @ a)).tolist(), np.nan_to_num(self.var_two * (b @ b)).tolist()
        by_a, by_b = np.argsort(-near_a, kind="stable").tolist(), np.argsort(-near_b, kind="stable").tolist()
        near_a, near_b = near_a.tolist(), near_b.tolist()
        heap = [(-near_a[by_a[0]] - near_b[by_b[0]], 0, 0)]
        while heap:
            far, x, y = heapq.heappop(heap)
            i, j = by_a[x], by_b[y]
            if y + 1 < self.k:
                heapq.heappush(heap, (-near_a[i] - near_b[by_b[y + 1]], x, y + 1))
            if y == 0 and x + 1 < self.k:
                heapq.heappush(heap, (-near_a[by_a[x + 1]] - near_b[j], x + 1, 0))
            cell = i * self.k + j
            if counts[self.base + cell]:
                yield self.base + cell, -far, math.sqrt(var_a[i] + var_b[j])

    def widest(self, q: np.ndarray) -> float:
        with np.errstate(all="ignore"):
            a, b = q[: self.cut] / self.scale, q[self.cut :] / self.scale
            return math.sqrt(float(np.nan_to_num(self.var_one.max() * (a @ a) + self.var_two.max() * (b @ b))))


def opened(book: Codebook, q: np.ndarray, counts: np.ndarray, first: int, floor: float | None, sigmas: float) -> list[int]:
    """The cells that a query opens: without ``floor`` the nearest ones until they have ``first`` entries; with it, the others
    whose entries may reach that score, ``sigmas`` deviations above the product with their centroids."""
    out, seen = [], 0
    square = book.scale * book.scale
    low = -math.inf if floor is None else float(np.clip(floor / square, -1e300, 1e300)) if math.isfinite(floor) else floor
    end = low - sigmas * book.widest(q)
    for cell, near, off in book.traverse(q, counts):
        if seen < first:
            seen += int(counts[cell])
            if floor is None:
                out.append(cell)
            continue
        if floor is None or near < end:
            break
        if near + sigmas * off >= low:
            out.append(cell)
    return out


# -- ranking ----------------------------------------------------------------------------------------------------------


def products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up in one order whatever rows stand around; not a number counts as the lowest."""
    with np.errstate(all="ignore"):
        return np.nan_to_num((rows * q).sum(axis=1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)


class Shard:
    """Entries of a run of cells, in the order of their cells, with the smallest (vec_id, row) of each distinct vector."""

    def __init__(self, row, dim: int):
        self.cells = np.frombuffer(row["cells"], np.int64)
        self.rows = np.frombuffer(row["data"]).reshape(-1, dim)
        self.begin = np.frombuffer(row["begin"], np.int64)
        self.ids, self.numbers = np.frombuffer(row["ids"], np.int64).tolist(), np.frombuffer(row["numbers"], np.int64).tolist()
        with np.errstate(all="ignore"):
            self.norm = float(np.sqrt((self.rows**2).sum(axis=1)).max())

    def rank(self, q: np.ndarray, own: int, cells: np.ndarray, k: int, floor: float) -> list[dict]:
        """The k nearest entries of the given cells that reach ``floor``, without the query's own row."""
        b, e = np.searchsorted(self.cells, cells, "left"), np.searchsorted(self.cells, cells, "right")
        at = np.concatenate([np.arange(x, y) for x, y in zip(b.tolist(), e.tolist(), strict=True)]) if len(b) else np.zeros(0, np.int64)
        if not len(at):
            return []
        with np.errstate(all="ignore"):
            rough = np.nan_to_num(self.rows[at] @ q, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            slack = 1e-12 * self.norm * float(np.sqrt(q @ q))
            least = max(floor, np.partition(rough, -(k + 1))[-(k + 1)]) if len(at) > k + 1 else floor
            maybe = at if not math.isfinite(slack) else at[rough >= least - slack]
        score = products(self.rows[maybe], q)
        if len(maybe) > k + 1:
            fine = score >= max(floor, np.partition(score, -(k + 1))[-(k + 1)])
            maybe, score = maybe[fine], score[fine]
        found = []
        for p, s in zip(maybe.tolist(), score.tolist(), strict=True):
            if s >= floor:
                found += [(-s, self.ids[m]) for m in range(self.begin[p], self.begin[p + 1]) if self.numbers[m] != own]
        return [{"score": -s, "vec_id": i} for s, i in heapq.nsmallest(k, found)]


# -- the search -------------------------------------------------------------------------------------------------------


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", cell: int = CELL, first: int = FIRST, sigmas: float = SIGMAS, sample: int = SAMPLE, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row chosen by ``queries``, by inner product.

    Equal vectors are one entry with the smallest ``k + 1`` of its rows (no list can hold more). The centroids of both halves
    are fitted on a bounded sample of ``sample`` entries of each length, ``sqrt(entries / cell)`` of them but no more than
    ``sample / 16``; every entry is indexed. A query first opens the cells nearest to it until they have ``first`` entries;
    the k-th score found there goes with it to all other cells whose entries may reach it: those whose product with the
    centroids lies no more than ``sigmas`` deviations of the entries below. Nothing caps what is opened then. Scores are
    computed on the original vectors; ties go to the smaller vec_id.

    Shards are runs of cells of about ``shard`` entries, and a cell with more is dealt over several; queries of a shard are
    dealt in blocks of about ``block``, so neither a dense cell nor one that many queries open is one task's.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows without an id, take no part; vectors
    of different length aren't compared; a product that isn't a number counts as the lowest. Query rows with one id get a list
    each; only the query's own row is left out, so another row with its id is listed. An empty table gives an empty result;
    other columns are left out.
    """
    bounded_batches(vectors.sparkSession)
    with scratch(vectors.sparkSession):
        rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
        return _searched(rows, k, cell, first, sigmas, sample, shard, block)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _fitted(nodes: DataFrame, cell: int, sample: int) -> dict[int, Codebook]:
    """The codebooks by length. What comes to the driver is one row for each length, with a bounded number of centroids."""
    found = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not found:
        return {}
    rows = drawn(nodes.select("dim", "v", F.xxhash64("v").alias("draw")), "dim", {d: min(n, sample) for d, n in found.items()}, found)
    wanted = {d: max(1, min(math.ceil(math.sqrt(n / cell)), max(1, sample // PER_CENTROID))) for d, n in found.items()}

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(key[0])
        pdf = pdf.sort_values("draw")
        x = np.array(pdf["v"].to_list(), np.float64)
        scale = 2.0 ** math.ceil(math.log2(max(np.abs(x).max(), 1e-300)))
        x, k, half = x / scale, min(wanted[dim], len(x)), -(-dim // 2)
        one, var_one = fit_half(x[:, :half], k)
        two, var_two = fit_half(x[:, half:], k)
        return pd.DataFrame({"dim": [dim], "k": [k], "scale": [scale]} | {c: [a.tobytes()] for c, a in (("one", one), ("var_one", var_one), ("two", two), ("var_two", var_two))})

    books, base = {}, 0
    fitted = rows.select("dim", "v", "draw").groupBy("dim").applyInPandas(fit, "dim int, k int, scale double, one binary, var_one binary, two binary, var_two binary")
    for r in sorted(fitted.collect(), key=lambda r: r["dim"]):
        data = tuple(np.frombuffer(r[c]).reshape(shape) for c, shape in (("one", (r["k"], -(-r["dim"] // 2))), ("var_one", -1), ("two", (r["k"], r["dim"] // 2)), ("var_two", -1)))
        books[r["dim"]] = Codebook(r["dim"], base, r["k"], r["scale"], data)
        base += r["k"] ** 2
    return books


def _searched(rows: DataFrame, k: int, cell: int, first: int, sigmas: float, sample: int, shard: int, block: int) -> DataFrame:
    spark = rows.sparkSession
    rows = rows.where(usable(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull())
    key = F.concat_ws("-", F.hex(F.xxhash64("v")), F.hex(F.xxhash64(F.lit(1), "v")), F.size("v"))
    rows = materialize(rows.select("vec_id", "v", "asks", F.size("v").alias("dim"), key.alias("key"), F.monotonically_increasing_id().alias("row")), "ann-rows")
    order = Window.partitionBy("key").orderBy("vec_id", "row")
    low = rows.select("key", "dim", "v", "vec_id", "row").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    nodes = low.groupBy("key").agg(F.first("dim").alias("dim"), F.first("v").alias("v"), F.sort_array(F.collect_list(F.struct("vec_id", "row"))).alias("members"))
    nodes = materialize(nodes.drop("key"), "ann-nodes")
    books = _fitted(nodes, cell, sample)
    size = sum(b.k**2 for b in books.values())

    def to_cells(batches):
        for b in cut(batches, 4096):
            dims = b.column("dim").to_numpy()
            cells = np.zeros(len(dims), np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                cells[at] = books[int(d)].cells(_matrix(b.column("v").take(pa.array(at))))
            yield pa.RecordBatch.from_arrays([b.column("dim"), pa.array(cells), b.column("v"), b.column("members")], names=["dim", "cell", "v", "members"])

    shape = "dim int, cell long, v array<double>, members array<struct<vec_id:long,row:long>>"
    placed = materialize(nodes.select("dim", "v", "members").mapInArrow(to_cells, shape), "ann-cells")

    def census(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(b.column("cell").to_numpy(), minlength=size)
        return total

    counts = count_table(placed.select("cell"), census, size) if size else np.zeros(0, np.int64)
    before, begin = np.zeros(size, np.int64), 0
    for d in sorted(books):  # each length begins a shard of its own
        at = slice(books[d].base, books[d].base + books[d].k ** 2)
        before[at] = begin + np.cumsum(counts[at]) - counts[at]
        begin = -(-int(before[at][-1] + counts[at][-1]) // shard) * shard

    def to_shards(batches):
        for n, b in enumerate(cut(batches, 4096)):
            cells = b.column("cell").to_numpy()
            spot = np.random.default_rng([SEED, n]).integers(0, counts[cells])  # any place among the entries of the cell
            yield pa.RecordBatch.from_arrays([pa.array((before[cells] + spot) // shard), *b.columns], names=["shard", *b.schema.names])

    def gather(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell")
        members = pdf["members"].to_list()
        begin = np.concatenate([[0], np.cumsum([len(m) for m in members])]).astype(np.int64)
        packed = {"cells": pdf["cell"].to_numpy(np.int64), "data": np.array(pdf["v"].to_list(), np.float64), "begin": begin}
        packed |= {name: np.array([x[c] for m in members for x in m], np.int64) for name, c in (("ids", "vec_id"), ("numbers", "row"))}
        return pd.DataFrame({"shard": [key[0]], "dim": [pdf["dim"].iloc[0]]} | {c: [a.tobytes()] for c, a in packed.items()})

    dealt = placed.mapInArrow(to_shards, f"shard long, {shape}")
    shards = dealt.groupBy("shard").applyInPandas(gather, "shard long, dim int, cells binary, data binary, begin binary, ids binary, numbers binary")
    shards = materialize(shards, "ann-shards")

    def visits(batches):
        for b in cut(batches, 256):
            out = []
            for r, q in zip(b.select(["dim", "row", "vec_id", "floor"]).to_pylist(), b.column("v").to_pylist(), strict=True):
                q = np.array(q, np.float64)
                cells = np.array(opened(books[r["dim"]], q, counts, first, r["floor"], sigmas), np.int64)
                cells = np.sort(cells)
                low, high = before[cells] // shard, (before[cells] + counts[cells] - 1) // shard
                for s in np.unique(np.concatenate([low, high])).tolist() if (high - low <= 1).all() else sorted({s for x, y in zip(low.tolist(), high.tolist(), strict=True) for s in range(x, y + 1)}):
                    out.append((s, r["row"], r["vec_id"], r["floor"], q.tobytes(), cells[(low <= s) & (high >= s)].tobytes()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "row", "query_id", "floor", "q", "cells"])

    def search(key, shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(shard) and len(asked):
            entries = Shard(shard.iloc[0], int(shard["dim"].iloc[0]))
            for row, query_id, floor, q, cells in zip(asked["row"], asked["query_id"], asked["floor"], asked["q"], asked["cells"], strict=True):
                low = -math.inf if floor is None or floor != floor else floor
                out.append((row, query_id, entries.rank(np.frombuffer(q), row, np.frombuffer(cells, np.int64), k, low)))
        return pd.DataFrame(out, columns=["row", "query_id", "best"])

    cores = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def ask(asked: DataFrame) -> DataFrame:
        """(row, query_id, score, vec_id) of the nearest entries of the cells that the queries open, those of a shard in blocks."""
        asked = asked.repartition(cores, F.xxhash64("row"))  # a query costs far more than its bytes tell; by its number alone it would be joined with what made it
        sent = materialize(asked.select("dim", "row", "vec_id", "floor", "v").mapInArrow(visits, "shard long, row long, query_id long, floor double, q binary, cells binary"), "ann-visits")
        plan = sent.groupBy("shard").agg(F.count("*").alias("visits"))
        plan = materialize(plan.withColumn("blocks", F.ceil(F.col("visits") / block).cast("int")), "ann-plan")
        total = sent.count()
        sent = heavy_split_join(sent, plan, "shard", "visits", total).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).drop("visits", "blocks")
        wide = shards.join(plan.select("shard", "blocks"), "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        found = wide.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInPandas(search, "row long, query_id long, best array<struct<score:double,vec_id:long>>")
        return found.select("row", "query_id", F.inline("best"))

    def ranked(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    asked = rows.where("asks").select("dim", "row", "vec_id", "v")
    home = materialize(ranked(ask(asked.withColumn("floor", F.lit(None).cast("double")))).select("row", "query_id", "score", "vec_id", "rank"), "ann-first")
    kth = home.where(F.col("rank") == k).select("row", F.col("score").alias("floor"))
    again = asked.join(kth, "row", "left").select("dim", "row", "vec_id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    every = home.drop("rank").unionByName(ask(again))
    return materialize(ranked(every).select("query_id", "rank", "vec_id", "score"), "ann-told", keep=True)
