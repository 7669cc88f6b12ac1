"""Vectors: near-duplicate links by rotated binary codes, and exact top-k search by KD-trees per shard."""

from __future__ import annotations

import heapq
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.graph import connected_components
from strandloom.operators.joins import heavy_split_join
from strandloom.session import materialize, scratch

#: Vectors in a block; a cell compares two blocks.
BLOCK = 16384
#: Width of the confidence interval, in standard deviations of the estimate: a link is missed with a chance below 1e-8.
SIGMAS = 6.0
TILE, CHUNK, SEED = 512, 100_000, 20240131
#: From this share of a tile's pairs the exact products are taken for the whole tile; those as near as ``EDGE`` to the
#: threshold are then taken pair by pair, as everywhere else, so that the result doesn't depend on the share.
DENSE, EDGE = 0.05, 1e-12
#: Rows of a KD-tree, of its leaves, and of a block of queries.
SHARD, LEAF, QUERIES = 8192, 128, 2048


def usable(vector: Column) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


# -- near-duplicates ------------------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix of at least 64 rows, the same everywhere; vectors are padded with zeros."""
    bits = max(64, -(-dim // 8) * 8)
    q, r = np.linalg.qr(np.random.default_rng(SEED + bits).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:, :dim]


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits of the rotated unit vectors, and each vector's correction factor: its product with its own code."""
    turned = unit @ rotation(unit.shape[1]).T
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def quantise(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors as whole numbers of 8 bits, their scales, and the most that a product with signs can be off."""
    scale = np.maximum(np.abs(turned).max(axis=1), 1e-12) / 127
    whole = np.rint(turned / scale[:, None]).astype(np.int8)
    return whole, scale.astype(np.float32), np.abs(turned - whole * scale[:, None]).sum(axis=1).astype(np.float32)


def floors(codes: np.ndarray, factors: np.ndarray, threshold: float, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
    """Signs of the codes, and the product with them below which a pair is ruled out.

    For a unit vector q at cosine c to y, ``<code(y), q> / factor`` is an unbiased estimate of c with a deviation of
    ``sqrt((1 - f^2) / f^2 / (bits - 1)) * sqrt(1 - c^2)``; the upper bound is ``sigmas`` of them above it.
    """
    bits = codes.shape[1] * 8
    signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
    f = np.maximum(factors, 1e-9)
    spread = np.sqrt(np.maximum(1 - f * f, 0) / (f * f) / (bits - 1)) * np.sqrt(max(0.0, 1 - threshold**2))
    return signs, (np.sqrt(bits) * f * (threshold - sigmas * spread) - 2e-3).astype(np.float32)


def undecided(whole: np.ndarray, scale: np.ndarray, off: np.ndarray, codes: np.ndarray, factors: np.ndarray, threshold: float, same: bool, sigmas: float = SIGMAS) -> tuple[np.ndarray, np.ndarray]:
    """The rows of either block that are in a pair which the estimates don't rule out (if ``same``, of one block with itself)."""
    signs, floor = floors(codes, factors, threshold, sigmas)
    xs, ys = np.zeros(len(whole), bool), np.zeros(len(codes), bool)
    for at in range(0, len(whole), TILE):
        to, first = min(at + TILE, len(whole)), at if same else 0
        turned = whole[at:to].astype(np.float32) * scale[at:to, None]
        maybe = turned @ signs[first:].T + off[at:to, None] >= floor[first:]
        if same:
            maybe &= np.arange(first, len(codes)) > np.arange(at, to)[:, None]
        xs[at:to] |= maybe.any(axis=1)
        ys[first:] |= maybe.any(axis=0)
    return np.flatnonzero(xs | ys if same else xs), np.flatnonzero(xs | ys if same else ys)


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest index of each component) after the edges a-b are added; ``label`` starts as ``arange``."""
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def link_cell(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray, codes: np.ndarray, factors: np.ndarray, threshold: float, same: bool, sigmas: float = SIGMAS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between the unit vectors ``x`` and ``y`` (``codes`` and ``factors`` are those of ``y``).

    Returns the linked weight of each x, of each y, and component labels over x followed by y (over x alone if ``same``).
    Pairs whose upper bound stays below the threshold are ruled out; the cosine of the others is computed in double precision.
    """
    signs, floor = floors(codes, factors, threshold, sigmas)
    turned = (x @ rotation(x.shape[1]).T).astype(np.float32)
    nx, ny = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    label = np.arange(len(x) + (0 if same else len(y)))
    shift = 0 if same else len(x)

    def sure(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        parts = [np.einsum("ij,ij->i", x[r[k : k + CHUNK]], y[c[k : k + CHUNK]]) >= threshold for k in range(0, len(r), CHUNK)]
        return np.concatenate(parts) if parts else np.zeros(0, bool)

    for at in range(0, len(x), TILE):
        to, first = min(at + TILE, len(x)), at if same else 0
        maybe = turned[at:to] @ signs[first:].T >= floor[first:]
        if maybe.sum() > DENSE * maybe.size:
            product = x[at:to] @ y[first:].T
            edge = np.nonzero(maybe & (np.abs(product - threshold) <= EDGE))
            maybe &= product >= threshold
            maybe[edge] = sure(at + edge[0], first + edge[1])
            r, c = np.nonzero(maybe)
            r, c = r + at, c + first
        else:
            r, c = np.nonzero(maybe)
            r, c = r + at, c + first
            keep = sure(r, c)
            r, c = r[keep], c[keep]
        if same:
            r, c = r[r < c], c[r < c]
        nx += np.bincount(r, wy[c], len(x)).astype(np.int64)
        ny += np.bincount(c, wx[r], len(y)).astype(np.int64)
        label = merge(label, r, c + shift)
    return nx, ny, label


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, sigmas: float = SIGMAS) -> DataFrame:
    """(vec_id, n_links, component_id, kept): links between vectors with a cosine of at least ``threshold``.

    Vectors with equal components are collapsed first; the distinct ones go to blocks of about ``block`` by a hash, and
    each pair of blocks is a cell. A cell gets codes and factors of one block and 8-bit rotated vectors of the other (some 90
    bytes for 64 components), and tells which rows are in pairs that the bounds don't rule out; only their vectors are sent
    to it then. What comes out is a count for each vector and a spanning forest, never pairs. A null, empty or zero vector,
    or one with null or non-finite components, links with nothing, and so do vectors of different length. Rows with equal ids
    are vectors of their own with that id; an empty table gives an empty result; other columns are left out.
    """
    with scratch(vectors.sparkSession):
        return _linked(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")), threshold, block, sigmas)


def _linked(rows: DataFrame, threshold: float, block: int, sigmas: float) -> DataFrame:
    nonzero = F.exists("v", lambda x: x != 0)
    key = F.concat_ws("-", F.hex(F.xxhash64("v")), F.hex(F.xxhash64(F.lit(1), "v")), F.size("v"))
    keyed = rows.withColumn("key", F.when(usable(F.col("v")) & nonzero, key))
    distinct = keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"), F.first("v").alias("v"))
    distinct = materialize(distinct.withColumns({"dim": F.size("v"), "node": F.monotonically_increasing_id()}), "vec-distinct")
    plan = distinct.groupBy("dim").agg(F.count("*").alias("rows_")).withColumn("blocks", F.ceil(F.col("rows_") / block).cast("int"))
    placed = heavy_split_join(distinct, plan, "dim", "rows_", distinct.count())
    placed = placed.select("dim", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("b"), "blocks", "node", "n", "v")

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        unit = np.array(pdf["v"].to_list(), np.float64)
        unit /= np.abs(unit).max(axis=1, keepdims=True)  # no overflow of the squares
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        codes, factors = encode(unit)
        whole, scale, off = quantise(unit @ rotation(unit.shape[1]).T)
        data = {"nodes": pdf["node"].to_numpy(np.int64), "n": pdf["n"].to_numpy(np.int64), "unit": unit, "codes": codes, "factors": factors, "whole": whole, "scale": scale, "off": off}
        return pd.DataFrame({c: [pdf[c].iloc[0]] for c in ("dim", "b", "blocks")} | {c: [v.tobytes()] for c, v in data.items()})

    shape = "dim int, b int, blocks int, nodes binary, n binary, unit binary, codes binary, factors binary, whole binary, scale binary, off binary"
    blocks = materialize(placed.groupBy("dim", "b").applyInPandas(gather, shape), "vec-blocks")
    one = blocks.select("dim", F.col("b").alias("i"), F.explode(F.sequence("b", F.col("blocks") - 1)).alias("j"), "whole", "scale", "off")
    two = blocks.select("dim", F.explode(F.sequence(F.lit(0), "b")).alias("i"), F.col("b").alias("j"), "codes", "factors")

    def estimate(key, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        dim, i, j = key
        x, y = one.iloc[0], two.iloc[0]
        scale, factors = np.frombuffer(x["scale"], np.float32), np.frombuffer(y["factors"])
        whole, codes = np.frombuffer(x["whole"], np.int8).reshape(len(scale), -1), np.frombuffer(y["codes"], np.uint8).reshape(len(factors), -1)
        xs, ys = undecided(whole, scale, np.frombuffer(x["off"], np.float32), codes, factors, threshold, bool(i == j), sigmas)
        ends = [(b, k.astype(np.int32).tobytes()) for b, k in ([(i, xs)] if i == j else [(i, xs), (j, ys)]) if len(xs)]
        return pd.DataFrame({"dim": [dim] * len(ends), "b": [e[0] for e in ends], "i": [i] * len(ends), "j": [j] * len(ends), "at": [e[1] for e in ends]})

    asked = one.groupBy("dim", "i", "j").cogroup(two.groupBy("dim", "i", "j")).applyInPandas(estimate, "dim int, b int, i int, j int, at binary")
    asked = materialize(asked, "vec-asked")

    def fetch(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, r in block.iterrows():  # one row
            nodes, n = np.frombuffer(r["nodes"], np.int64), np.frombuffer(r["n"], np.int64)
            unit = np.frombuffer(r["unit"]).reshape(len(nodes), -1)
            for b, i, j, at in zip(asked["b"], asked["i"], asked["j"], asked["at"], strict=True):
                k = np.frombuffer(at, np.int32)
                out.append((r["dim"], i, j, b, nodes[k].tobytes(), n[k].tobytes(), unit[k].tobytes()))
        return pd.DataFrame(out, columns=["dim", "i", "j", "b", "nodes", "n", "unit"])

    vectors = blocks.select("dim", "b", "nodes", "n", "unit").groupBy("dim", "b").cogroup(asked.groupBy("dim", "b"))
    vectors = vectors.applyInPandas(fetch, "dim int, i int, j int, b int, nodes binary, n binary, unit binary")

    def compare(key, pdf: pd.DataFrame) -> pd.DataFrame:
        dim, i, j = key
        ends = []
        for b in (i, j):
            r = pdf[pdf["b"] == b].iloc[0]
            nodes = np.frombuffer(r["nodes"], np.int64)
            ends.append((nodes, np.frombuffer(r["n"], np.int64), np.frombuffer(r["unit"]).reshape(len(nodes), dim)))
        (kx, wx, x), (ky, wy, y) = ends
        nx, ny, label = link_cell(x, wx, y, wy, *encode(y), threshold, bool(i == j), sigmas)
        names = kx if i == j else np.concatenate([kx, ky])
        linked = nx + ny if i == j else np.concatenate([nx, ny])
        at = np.flatnonzero(linked)
        return pd.DataFrame({"node": names[at], "peer": names[label[at]], "links": linked[at]})

    found = vectors.groupBy("dim", "i", "j").applyInPandas(compare, "node long, peer long, links long")
    found = materialize(found, "vec-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found, "node", "peer")
    info = distinct.select("key", "node", "first_id", "n").join(links, "node", "left")
    info = materialize(info.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node"), "vec-info")
    least = info.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("w"))
    least = materialize(least, "vec-components")
    info = heavy_split_join(info, least, "component", "w", info.count())
    info = info.select("key", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    info = materialize(info, "vec-told", keep=True)
    total = info.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    out = heavy_split_join(keyed.select("vec_id", "key"), info, "key", "n", total)
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


# -- exact top-k ----------------------------------------------------------------------------------------------------


class KdTree:
    """Median splits on the widest dimension down to leaves of ``LEAF`` rows, with the tight box of every node.

    ``bounds(q)`` is the largest inner product that a row in each node's box can have with each query.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF, numbers: np.ndarray | None = None):
        self.nodes: list[tuple[int, int, int, int]] = []  # begin, end, left child, right child
        order = np.arange(len(ids))
        self._split(rows, order, 0, len(ids), leaf)
        self.ids, self.rows = ids[order], rows[order]
        self.numbers = (ids if numbers is None else numbers)[order]
        self.low = np.array([self.rows[b:e].min(axis=0) for b, e, _, _ in self.nodes])
        self.high = np.array([self.rows[b:e].max(axis=0) for b, e, _, _ in self.nodes])
        self.least = [int(self.ids[b:e].min()) for b, e, _, _ in self.nodes]

    def _split(self, rows: np.ndarray, order: np.ndarray, begin: int, end: int, leaf: int) -> int:
        at = len(self.nodes)
        self.nodes.append((begin, end, -1, -1))
        if end - begin > leaf:
            part = rows[order[begin:end]]
            d, mid = int((part.max(axis=0) - part.min(axis=0)).argmax()), (end - begin) // 2
            order[begin:end] = order[begin:end][np.argpartition(part[:, d], mid)]
            left = self._split(rows, order, begin, begin + mid, leaf)
            self.nodes[at] = (begin, end, left, self._split(rows, order, begin + mid, end, leaf))
        return at

    def bounds(self, q: np.ndarray) -> np.ndarray:
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T

    def search(self, own: int, q: np.ndarray, bounds: np.ndarray, k: int, best: list[tuple]) -> list[tuple]:
        """The k best (score, -id) of this tree, but for the row numbered ``own``, and of ``best``; ties go to the smaller id.
        Best-first: the node with the largest bound is opened next, and the search ends when no bound can reach the kth
        score any more."""
        best = sorted(best, reverse=True)[:k]
        heap = [(-bounds[0], 0)]
        while heap:
            bound, at = heapq.heappop(heap)
            if len(best) == k and -bound < best[-1][0]:
                break
            if len(best) == k and (-bound, -self.least[at]) <= best[-1]:
                continue
            begin, end, left, right = self.nodes[at]
            if left < 0:
                score = self.rows[begin:end] @ q
                hit = np.flatnonzero(score >= best[-1][0]) if len(best) == k else np.arange(end - begin)
                if len(hit):
                    found = zip(score[hit].tolist(), self.ids[begin + hit].tolist(), self.numbers[begin + hit].tolist(), strict=True)
                    more = [(s, -i) for s, i, n in found if n != own]
                    best = heapq.nlargest(k, best + more)
            else:
                for child in (left, right):
                    if len(best) < k or bounds[child] >= best[-1][0]:
                        heapq.heappush(heap, (-bounds[child], child))
        return best


def _packed(rows: np.ndarray) -> bytes:
    """Integer rows in the fewest bytes a number, which come first."""
    top = int(np.abs(rows).max()) if rows.size else 0
    width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return bytes([width]) + rows.astype(f"<i{width}").tobytes()


def _unpacked(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).reshape(-1, dim).astype(np.int64)


def _numbers(rows: np.ndarray) -> np.ndarray:
    """Integer rows as doubles where their products are exact in them, else as they are."""
    return rows.astype(np.float64) if not rows.size or float(np.abs(rows).max()) ** 2 * rows.shape[1] < 2**51 else rows


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each row chosen by ``queries``.

    Components count as ``floor(256 * x)``. A query first searches the tree of its own shard; its kth score then goes with
    it to all other shards, where it cuts off boxes from the start. Scores are exact, and ties go to the smaller vec_id.
    Rows are numbered in a written copy, so two query rows with one id get a list each, only the query's own row is no
    candidate of it, and a repeated candidate is listed as often as it occurs.
    Vectors that are null or empty or hold null or non-finite components take no part, nor do rows without an id; vectors of
    different length aren't compared; an empty table gives an empty result; other columns are left out. Components so large
    that a score might not fit 64 bits raise a ValueError.
    """
    with scratch(vectors.sparkSession):
        return _best(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), queries.alias("asks")), k, shard, block)


def _best(rows: DataFrame, k: int, shard: int, block: int) -> DataFrame:
    rows = rows.where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    rows = rows.select("vec_id", F.transform("v", lambda x: F.floor(x * 256).cast("long")).alias("v"), F.coalesce("asks", F.lit(False)).alias("asks"), F.size("v").alias("dim"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "topk-rows")
    size = F.greatest(F.array_max("v").cast("double"), -F.array_min("v").cast("double"))
    most = rows.agg(F.max(size * size * F.col("dim")).alias("most")).first()["most"]
    if most is not None and most >= 2.0**63:
        raise ValueError(f"scores of up to {most:.3g} don't fit 64 bits")
    plan = rows.groupBy("dim").agg(F.count("*").alias("rows_"), F.count_if("asks").alias("asked"))
    plan = plan.select("dim", "rows_", F.ceil(F.col("rows_") / shard).cast("int").alias("shards"), F.greatest(F.lit(1), F.ceil(F.col("asked") / block)).cast("int").alias("blocks"))
    rows = heavy_split_join(rows, plan, "dim", "rows_", rows.count())
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "row"), F.col("blocks")).cast("int"))

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        data = np.array(pdf["v"].to_list(), np.int64)
        return pd.DataFrame({c: [pdf[c].iloc[0]] for c in ("dim", "shard", "shards", "blocks")} | {"ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "numbers": [pdf["row"].to_numpy(np.int64).tobytes()], "data": [_packed(data)]})

    shape = "dim int, shard int, shards int, blocks int, ids binary, numbers binary, data binary"
    trees = materialize(rows.groupBy("dim", "shard").applyInPandas(gather, shape), "topk-shards")
    asked = rows.where("asks").select("dim", "shard", "shards", "block", "row", "vec_id", "v")
    found = "dim int, shards int, block int, home int, row long, query_id long, v binary, best array<struct<score:long,vec_id:long>>"

    def tree_of(t: pd.DataFrame, dim: int) -> KdTree:
        return KdTree(np.frombuffer(t["ids"].iloc[0], np.int64), _numbers(_unpacked(t["data"].iloc[0], dim)), numbers=np.frombuffer(t["numbers"].iloc[0], np.int64))

    def answer(tree: KdTree, q: np.ndarray, numbers: list[int], seeds: list[list]) -> list[list[dict]]:
        q = q.astype(tree.rows.dtype) if tree.rows.dtype == np.int64 or float(np.abs(q).max()) * float(np.abs(tree.rows).max()) * q.shape[1] < 2**52 else q
        if q.dtype != tree.rows.dtype:
            tree.rows, tree.low, tree.high = (a.astype(np.int64) for a in (tree.rows, tree.low, tree.high))
        bounds, out = tree.bounds(q), []
        for r, own in enumerate(numbers):
            best = tree.search(own, q[r], bounds[r], k, seeds[r])
            out.append([{"score": int(s), "vec_id": -int(i)} for s, i in best])
        return out

    def at_home(key, t: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({c.split()[0]: pd.Series([], dtype=object) for c in found.split(", ")})
        q = np.array(pdf["v"].to_list(), np.int64)
        best = answer(tree_of(t, int(key[0])), q, pdf["row"].tolist(), [[]] * len(pdf))
        return pd.DataFrame({"dim": pdf["dim"], "shards": pdf["shards"], "block": pdf["block"], "home": pdf["shard"], "row": pdf["row"], "query_id": pdf["vec_id"], "v": [_packed(x) for x in q], "best": best})

    home = materialize(trees.groupBy("dim", "shard").cogroup(asked.groupBy("dim", "shard")).applyInPandas(at_home, found), "topk-home")

    def away(key, t: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["home"] != key[1]]
        if not len(pdf) or not len(t):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("row", "query_id", "best")})
        dim = int(key[0])
        floor = [[(b["score"], -b["vec_id"]) for b in best] for best in pdf["best"]]
        got = answer(tree_of(t, dim), np.vstack([_unpacked(v, dim) for v in pdf["v"]]), pdf["row"].tolist(), floor)
        return pd.DataFrame({"row": pdf["row"], "query_id": pdf["query_id"], "best": [_without(b, seed) for b, seed in zip(got, floor, strict=True)]})

    wide = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = home.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    pair = "row long, query_id long, best array<struct<score:long,vec_id:long>>"
    others = wide.groupBy("dim", "shard", "block").cogroup(sent.groupBy("dim", "shard", "block")).applyInPandas(away, pair)
    every = home.select("row", "query_id", "best").unionByName(others).select("row", "query_id", F.inline("best"))
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return materialize(ranked.select("query_id", "rank", "vec_id", "score"), "topk-told", keep=True)


def _without(best: list[dict], seed: list[tuple]) -> list[dict]:
    """What a shard adds to the scores that came with the query: each of those is taken away once."""
    left, out = Counter(seed), []
    for b in best:
        if left[b["score"], -b["vec_id"]] > 0:
            left[b["score"], -b["vec_id"]] -= 1
        else:
            out.append(b)
    return out
