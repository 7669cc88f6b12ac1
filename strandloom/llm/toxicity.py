"""Toxicity by a classifier chain: each category's linear model also sees the probabilities of the categories before it.

The features of a text are the numbers of its distinct words, and of their beginnings, in hashed buckets. Models are fitted
by FTRL-proximal to all labelled documents, many of them in shards; the probabilities that a later model learns from are out of fold, so that it isn't misled by how well
the earlier models know their own training rows.
"""

from __future__ import annotations

import itertools
import zlib
from array import array
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import bounded_batches, count_table, cut
from strandloom.llm.ftrl import Ftrl
from strandloom.session import materialize, scratch

BITS, PREFIX = 18, 4
#: Marks at the ends of a run between white space that aren't of its word.
MARKS = ".,;:!?\"'()*&%$#"
#: Labelled rows, and distinct features of them in all, up to which the chain is fitted on the driver.
DRIVER_ROWS, DRIVER_CELLS = 2000, 2_000_000
FOLDS, EPOCHS, L1 = 3, 3, 10.0
#: Buckets of ids that are marked where one of them is labelled.
MARK_BITS = 20
#: Rows, and distinct features of them, of a shard of a larger table, and steps of a unit of log odds by which rows are counted.
SHARD_ROWS, SHARD_CELLS, STEPS = 12_000, 8_000_000, 1024
#: Runs in a worker's tables before they start anew.
TABLE_ROWS = 500_000
#: Later models see earlier probabilities as log odds times this.
CHAIN_SCALE = 0.25
#: No probability reaches this: the threshold of a chain that has seen no row with the last category.
NEVER = 2.0

#: Category -> expression over the label columns; the chain goes in this order.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def words(text: str | None) -> set[str]:
    """Distinct words of a whole text: runs between white space in lower case, without marks at their ends."""
    return {w.strip(MARKS) for w in tokens(text)} - {""}


def tokens(text: str | None) -> set[str]:
    """Distinct runs between white space in lower case, marks and all: each is looked up once, not once an occurrence."""
    return set((text or "").lower().split())


class Words:
    """Numbers of words, by the runs that they come from, and their buckets: a worker cuts and hashes a run once."""

    def __init__(self):
        self.runs, self.numbers, self.places = {}, {}, array("I")

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of a text's distinct words and of their beginnings, in order, and how many words are in each."""
        if len(self.runs) > TABLE_ROWS:
            self.__init__()
        found, runs = tokens(text), self.runs
        for run in found.difference(runs):
            word = run.strip(MARKS)
            number = self.numbers.setdefault(word, len(self.numbers)) if word else -1
            if 2 * number == len(self.places):
                self.places.extend(buckets(word))
            runs[run] = number
        numbers = np.unique(np.fromiter(map(runs.__getitem__, found), np.int64, len(found)))
        return np.unique(np.frombuffer(self.places, np.uint32).reshape(-1, 2)[numbers[numbers >= 0]], return_counts=True)


def buckets(word: str) -> tuple[int, int]:
    """The buckets of a word and of its beginning."""
    mask = (1 << BITS) - 1
    return zlib.crc32(_encoded(word)) & mask, zlib.crc32(b"^" + _encoded(word[:PREFIX])) & mask


def _encoded(word: str) -> bytes:
    return word.encode("utf-8", "surrogatepass")


_START = itemgetter(slice(PREFIX))


class Starts(dict):
    """The buckets of beginnings, which are few and come again: a worker hashes one once. Most words come once, and are hashed where they stand."""

    def __missing__(self, start: str) -> int:
        self[start] = buckets(start)[1]
        return self[start]


class Chain:
    """Categories in order, with weights by bucket, biases, weights of the earlier categories' log odds, and the
    probability from which on the last category holds."""

    def __init__(self, categories: list[str], weights: np.ndarray, bias: np.ndarray, links: np.ndarray, threshold: float = NEVER):
        self.categories, self.weights, self.bias, self.links, self.threshold = categories, weights, bias, links, threshold
        self.known, self.starts = weights.any(axis=1), Starts()

    def __getstate__(self):
        return self.__dict__ | {"starts": Starts()}

    def chained(self, base: np.ndarray) -> np.ndarray:
        """Probabilities from the words' scores, category by category."""
        p = np.zeros(base.shape)
        for k in range(base.shape[1]):
            z = base[:, k] + log_odds(p[:, :k]) @ self.links[k, :k]
            p[:, k] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return p

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """(texts, categories) probabilities."""
        base = np.tile(self.bias, (len(texts), 1))
        for r, text in enumerate(texts):
            if len(self.starts) > TABLE_ROWS:
                self.starts.clear()
            found = words(text)
            at = np.fromiter(itertools.chain(map(zlib.crc32, map(_encoded, found)), map(self.starts.__getitem__, map(_START, found))), np.int64, 2 * len(found))
            at &= (1 << BITS) - 1
            base[r] += self.weights[at[self.known[at]]].sum(axis=0)
        return self.chained(base)


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return CHAIN_SCALE * np.log(p / (1 - p))


class _Linked:
    """Rows with the earlier categories' log odds as further features, put together when one is asked for."""

    def __init__(self, rows: list, extra: np.ndarray, size: int, which=None):
        self.rows, self.extra, self.more = rows, extra, size + np.arange(extra.shape[1], dtype=np.int32)
        self.which = range(len(rows)) if which is None else which

    def of(self, which) -> _Linked:
        return _Linked(self.rows, self.extra, int(self.more[0]) if len(self.more) else 0, which)

    def __len__(self) -> int:
        return len(self.which)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        r = self.which[k]
        _, at, n = self.rows[r]
        return np.concatenate([at, self.more]), np.concatenate([n, self.extra[r]], dtype=np.float64)


def best_threshold(p: np.ndarray, y: np.ndarray, cost: tuple[float, float], counts: np.ndarray | None = None) -> float:
    """The probability from which on a row counts as positive, at the least cost on rows that the models haven't seen.

    ``cost`` is that of a negative and of a positive row on the wrong side; ``counts`` are the rows of each entry (None: one). Of equal costs the middle of the widest gap (in log odds) is taken. Without positives it is ``NEVER``.
    """
    if not (y == 1).any():
        return NEVER
    z = np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
    order = np.argsort(z)
    z, y, counts = z[order], y[order], (np.ones(len(z)) if counts is None else counts)[order]
    wrong = np.concatenate([[0.0], np.cumsum(np.where(y == 1, cost[1], -cost[0]) * counts)])  # beside that of taking all
    ends = np.concatenate([[-14.0], z, [14.0]])
    gap = np.diff(ends)
    good = (wrong <= wrong.min() + 1e-9) & (gap > 0)
    good = good if good.any() else gap > 0
    k = int(np.flatnonzero(good)[gap[good].argmax()])
    return float(1 / (1 + np.exp(-(ends[k] + ends[k + 1]) / 2)))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], labels: np.ndarray, categories: list[str], folds: int = FOLDS, epochs: int = EPOCHS, l1: float = L1, l2: float = 1e-3, alpha: float = 0.5, cost: tuple[float, float] = (1.0, 1.0)) -> Chain:
    """Fit the chain on (fold, buckets, counts) rows; rows of one fold (copies among them) are never judged by a model that saw another of it."""
    size, n, k = 1 << BITS, len(rows), len(categories)
    fold = np.array([r[0] % folds for r in rows], np.int64)
    weights, bias, links, extra = np.zeros((size, k)), np.zeros(k), np.zeros((k, k)), np.zeros((n, k), np.float32)
    for c in range(k):
        x = _Linked(rows, extra[:, :c], size)
        y = labels[:, c]
        know = np.flatnonzero(y >= 0)

        def model(which: np.ndarray, x=x, y=y, c=c) -> Ftrl:
            return Ftrl(size + c, 1, alpha=alpha, l1=l1, l2=l2).fit(x.of(which), y[which], epochs)

        whole = model(know)
        w = whole.dense()[:, 0]
        weights[:, c], bias[c], links[c, :c] = w[:size], w[-1], w[size : size + c]
        p, told = np.zeros(n), np.zeros(n, bool)
        for f in range(folds):
            out, rest = np.flatnonzero(fold == f), know[fold[know] != f]
            p[out] = _probability(model(rest), x.of(out))
            told[out] = len(np.unique(y[rest])) == 2
        extra[:, c] = log_odds(p)
    judged = know[told[know]]
    if len(np.unique(y[judged])) < 2:  # all rows with (or without) the category are copies of one fold
        p, judged = _probability(whole, x), know
    return Chain(categories, weights, bias, links, best_threshold(p[judged], y[judged], cost))


def _probability(model: Ftrl, x: _Linked) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.scores(x)[:, 0], -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, driver_rows: int = DRIVER_ROWS, driver_cells: int = DRIVER_CELLS) -> Chain:
    """Learn from (doc_id, text) and labels (doc_id and the label columns): from every labelled document, none is left out.

    Up to ``driver_rows`` documents with ``driver_cells`` distinct features in all are fitted row by row on the driver; more are
    fitted where they lie, in shards whose models are put together after each pass. Folds follow the
    words, so that copies share one; the threshold is that of the least cost out of fold, over all labelled documents. A label
    that is null is not learned from.
    """
    bounded_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        return _fitted(docs, labels, categories or CATEGORIES, driver_rows, driver_cells)


def _fitted(docs: DataFrame, labels: DataFrame, categories: dict[str, str], driver_rows: int, driver_cells: int) -> Chain:
    names = list(categories)
    last = names[-1]
    told = labels.where("doc_id is not null").select("doc_id", *(F.expr(e).cast("int").alias(c) for c, e in categories.items()))
    told = told.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in names)).where(F.col(last).isin(0, 1))
    told = materialize(told.withColumn("bucket", _bucket("doc_id")), "toxicity-told")
    marked = docs.sparkSession.sparkContext.broadcast(count_table(told.select("bucket"), _marks, 1 << MARK_BITS, "int32") > 0)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Words()
        for b in cut(batches, 100):
            b, out = b.filter(pa.array(marked.value[b.column(2).to_numpy()])), []
            for text in b.column(3).to_pylist():
                at, n = seen.features(text)
                out.append((len(at), at.tobytes(), n.astype(np.min_scalar_type(int(n.max(initial=0)))).tobytes()))
            cols = [*b.columns[:2], *(pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.binary())))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "draw", "cells", "at", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("doc_id", "text").alias("draw"), _bucket("doc_id").alias("bucket"), "text")
    rows = texts.mapInArrow(features, f"doc_id {kind}, draw long, cells long, at binary, n binary").join(told.drop("bucket"), "doc_id")
    rows = materialize(rows.dropDuplicates(["doc_id", "draw"]).drop("doc_id"), "toxicity-rows")
    total, cells = rows.agg(F.count("*"), F.coalesce(F.sum("cells"), F.lit(0))).first()
    if not total:
        return Chain(names, np.zeros((1 << BITS, len(names))), np.full(len(names), -40.0), np.zeros((len(names), len(names))))
    if total > driver_rows or cells > driver_cells:
        shards = max(-(-total // SHARD_ROWS), -(-cells // SHARD_CELLS))
        return _fitted_apart(rows, names, shards, max(1, total / SHARD_ROWS, shards / 2))
    x, y = [], []
    for r in rows.coalesce(4).toLocalIterator():  # the driver holds one form of a row at a time
        x.append((r["draw"], zlib.crc32(r["at"]), *_unpacked(r["at"], r["n"], r["cells"])))
        y.append([-1 if r[c] is None else r[c] for c in names])
    order = sorted(range(len(x)), key=lambda k: x[k][0])
    x, y = [x[k][1:] for k in order], np.array([y[k] for k in order], np.int64)
    return train(x, y, names)


def _bucket(doc_id: str):
    """Of texts, only those whose bucket has a labelled id are cut into words, and no text is shuffled."""
    return F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(1 << MARK_BITS))


def _marks(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    total = np.zeros(1 << MARK_BITS, np.int32)
    for b in batches:
        total[b.column(0).to_numpy()] = 1
    return total


def _unpacked(at: bytes, n: bytes, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts, which have as few bytes as the row needs."""
    return np.frombuffer(at, np.uint32).astype(np.int32), np.frombuffer(n, f"<u{max(1, len(n) // max(1, cells))}")


def _fitted_apart(rows: DataFrame, names: list[str], shards: int, part: float, folds: int = FOLDS, epochs: int = EPOCHS, l1: float = L1, l2: float = 1e-3, alpha: float = 0.5) -> Chain:
    """The chain of ``train`` over a table of any size, none of whose rows leaves it: in each of ``epochs`` rounds every shard goes on
    from the shared state of each model, over all of its rows. What the shards add is summed and divided by ``part``: the number
    of times that the rows hold ``SHARD_ROWS``, which the penalty is meant for, but half of the shards at least.

    What reaches the driver are states and counts of rows by their log odds (in steps of ``1 / STEPS``), from which the threshold
    is taken. Shards are dealt by hash, so their number grows with the rows and one of them is what ``train`` holds.
    """
    spark, k, models = rows.sparkSession, len(names), folds + 1  # the last model is that of all folds
    wide = (1 << BITS) + k  # the bias comes last
    rows = rows.select("draw", "cells", "at", "n", *names, F.pmod(F.xxhash64("draw"), F.lit(shards)).cast("int").alias("shard"))
    rows = materialize(rows.repartitionByRange(shards, "shard"), "toxicity-shards")  # a file is a shard or more, and each is one row group
    state, done = np.zeros((models, 2, wide), np.float32), []  # sent in single precision, learned in double

    def read(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple]]:
        """Rows (fold, buckets, counts, labels) by shard, in the order of their draws."""
        found: dict[int, list[tuple]] = {}
        for b in batches:
            for draw, cells, at, n, *y, shard in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found.setdefault(shard, []).append((draw, zlib.crc32(at) % folds, *_unpacked(at, n, cells), [-1 if v is None else v for v in y]))
        return {shard: [r[1:] for r in sorted(own, key=lambda r: r[0])] for shard, own in found.items()}

    def before(own: list[tuple], weights: list[np.ndarray]) -> np.ndarray:
        """Log odds of the categories whose models are done, by the model that hasn't seen the row's fold."""
        extra = np.zeros((len(own), len(weights)))
        for r, (f, at, n, _) in enumerate(own):
            for e, w in enumerate(weights):
                z = w[f][at] @ n.astype(float) + w[f][1 << BITS : (1 << BITS) + e] @ extra[r, :e] + w[f][-1]
                extra[r, e] = log_odds(1 / (1 + np.exp(-np.clip(z, -40, 40))))
        return extra

    def empty(c: int) -> Ftrl:
        return Ftrl((1 << BITS) + c, 1, alpha=alpha, l1=l1, l2=l2)

    def places(at: np.ndarray, c: int) -> np.ndarray:
        return np.where(at == (1 << BITS) + c, wide - 1, at)

    for c in range(k):
        state[:] = 0
        for epoch in range(epochs):
            sent = spark.sparkContext.broadcast((state, done))

            def add(batches: Iterator[pa.RecordBatch], c=c, epoch=epoch, sent=sent) -> np.ndarray:
                now, weights = sent.value
                total = np.zeros((models, 2, wide))
                for own in read(batches).values():
                    x = _Linked([r[:3] for r in own], before(own, weights).astype(np.float32), 1 << BITS)
                    fold, y = np.array([r[0] for r in own]), np.array([r[3][c] for r in own])
                    model = empty(c).hold(x)
                    at, placed = places(model.at, c), [model.placed(*x[r], np.float32) for r in range(len(own))]  # for all models
                    for f in range(models):
                        which = np.flatnonzero((y >= 0) & (fold != f))
                        order = np.random.default_rng(7)
                        which = which[[order.permutation(len(which)) for _ in range(epoch + 1)][-1]]
                        z, n = np.ascontiguousarray(now[f, :, at].T, float)  # what isn't contiguous is copied whole for every row
                        model.learn_placed(z, n, (placed[r] for r in which), y[which].tolist())
                        total[f, :, at] += np.stack([z, n], axis=1) - now[f, :, at]
                return total.ravel()

            more = count_table(rows, add, state.size, "float32").reshape(state.shape)
            state += np.divide(more, part, out=more)
            sent.destroy()
        weights = np.zeros((models, wide))
        for f in range(models):
            model = empty(0)
            model.z, model.n = state[f, 0][:, None].astype(float), state[f, 1][:, None].astype(float)
            weights[f] = model.weights()[:, 0]
        done = [*done, weights]

    steps = 14 * STEPS

    def told(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((2, 2 * steps + 1), np.int64)
        for own in read(batches).values():
            z = before(own, done)[:, -1] / CHAIN_SCALE
            np.add.at(total, (np.array([r[3][-1] for r in own]), np.round(z * STEPS).astype(int) + steps), 1)
        return total.ravel()

    found = count_table(rows, told, 2 * (2 * steps + 1)).reshape(2, -1)
    y, at = np.nonzero(found)
    whole = np.stack([w[-1] for w in done], axis=1)
    links = np.zeros((k, k))
    for c in range(k):
        links[c, :c] = whole[1 << BITS : (1 << BITS) + c, c]
    p = 1 / (1 + np.exp(-(at - steps) / STEPS))
    return Chain(names, whole[: 1 << BITS], whole[-1], links, best_threshold(p, y, (1.0, 1.0), found[y, at]))


def score(docs: DataFrame, chain: Chain, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``p_<category>`` of each row's whole text, beside the columns named in ``carry``, in one narrow pass."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    at = carry.index("text") if "text" in carry else len(carry)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches):
            p = sent.value.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], *(pa.array(p[:, k], pa.float64()) for k in range(len(names)))], names=[*carry, *names])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), *(f"{c} double" for c in names)])
    return docs.select(*carry, *([] if "text" in carry else ["text"])).mapInArrow(run, schema)


def rate_toxicity(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """(doc_id, p_low_quality, p_toxic, toxic) of every document, ``toxic`` where p_toxic >= ``threshold`` (None: that of the
    least cost on labelled rows out of fold).

    A null or empty text has no word, so its probabilities are the biases'. Without labels nothing is toxic. Repeated rows
    are rated alike; an empty table gives an empty result; other columns are of no account.
    """
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    chain = fit(rows, labels)
    return score(rows, chain).withColumn("toxic", F.col("p_toxic") >= F.lit(chain.threshold if threshold is None else threshold))
