"""Packing of token ids into sequences by best-fit decreasing.

A segment tree over the remaining capacities finds the tightest open window for each piece; documents that are longer than
a window are first cut into full ones. What is still open at the end of a shard is closed by cutting the pieces of its
emptiest windows, so that a shard leaves no more than a few pad tokens.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandloom.llm.common import bounded_batches
from strandloom.llm.common import cut as cut_batches

WINDOW, SLACK, END_ID = 2048, 8, 1
#: A shard is packed once it has so many tokens: bounds a worker's memory; shards never depend on each other.
SHARD_TOKENS = 4_000_000
#: Entries of a worker's table of words before it starts anew.
WORD_ROWS = 1_000_000
#: A run of these at the end of a word is a pre-token of its own (an apostrophe may not be).
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A point or comma beside another character that is neither white space, a letter nor a digit: they are one pre-token.
CLASH = re.compile(r"[.,][^\w\s]|[^\w\s][.,]|_[.,]|[.,]_")

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"
_TABLES: dict[str, WordTable] = {}


class WordTable:
    """Distinct word -> its ids (little-endian unsigned 32-bit) by the tokenizers library.

    The vocabulary's pre-tokenizer never joins characters across white space, nor a lone point or comma with anything, and
    each pre-token ends in an id whose piece ends with ``</w>``; so many words are encoded in one call and cut at those ids.
    """

    def __init__(self, path: str, word_rows: int = WORD_ROWS):
        from tokenizers import Tokenizer

        self.tk, self.word_rows = Tokenizer.from_file(path), word_rows
        size = self.tk.get_vocab_size(with_added_tokens=True)
        self.last = np.array([(self.tk.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tk.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, words: list[str]) -> None:
        """Encode words that are one pre-token each."""
        groups = [words[at : at + 64] for at in range(0, len(words), 64)]
        for group, got in zip(groups, self.tk.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):
                data, begin = ids.tobytes(), 0
                for w, e in zip(group, (4 * ends).tolist(), strict=True):
                    self.words[w], begin = data[begin:e], e
            else:
                self.words.update((w, self.whole(w)) for w in group)

    def learn(self, words: set[str]) -> None:
        if len(self.words) > self.word_rows:
            self.words.clear()
        rows, new = self.words, list(words.difference(self.words))
        plain, rest = set(), {}
        for w in new:
            if w.isalpha():
                plain.add(w)
            else:
                core = w.rstrip(PUNCTUATION)
                rest[w] = (core, w[len(core) :])
        joined = {w: x for w, x in rest.items() if not x[0] or x[0].isalpha()}
        self._encode(list(plain.union(p for x in joined.values() for p in x if p and p not in rows)))
        for w, (core, tail) in rest.items():
            if w not in joined:
                rows[w] = self.whole(w)
            elif core and tail:
                rows[w] = rows[core] + rows[tail]

    def encode_batch(self, texts: list[str | None]) -> Iterator[bytes]:
        for at in range(0, len(texts), 256):
            group = [t or "" for t in texts[at : at + 256]]
            cuts = [None if odd(t) else cut(t) for t in group]
            self.learn(set().union(*filter(None, cuts)))
            get = self.words.__getitem__
            for text, words in zip(group, cuts, strict=True):
                yield self.whole(text) if words is None else b"".join(map(get, words))


def cut(text: str) -> list[str]:
    """Runs of a text between white space, with points and commas apart; A-Z and Latin letters in lower case, as the
    vocabulary has them."""
    try:
        text.encode("latin-1")
        text = text.lower()
    except UnicodeEncodeError:
        pass
    return text.split() if CLASH.search(text) else text.replace(".", " . ").replace(",", " , ").split()


def odd(text: str) -> bool:
    """Whether a text can't be cut at white space first: special tokens, separators that only Python splits at, characters
    that normalisation can join or whose lower case is longer."""
    if "<|" in text or any(x in text for x in "\x1c\x1d\x1e\x1f"):
        return True
    return not text.isascii() and ("İ" in text or not unicodedata.is_normalized("NFC", text))


class CapacityTree:
    """Open windows by remaining capacity; ``tightest(size)`` is the smallest capacity of at least ``size`` in O(log W)."""

    def __init__(self, window: int):
        self.base = 1 << window.bit_length()
        self.count = [0] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        k = self.base + capacity
        while k:
            self.count[k] += by
            k >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._add(capacity, 1)

    def take(self, capacity: int) -> int:
        self._add(capacity, -1)
        return self.open[capacity].pop()

    def tightest(self, size: int) -> int | None:
        count, k = self.count, self.base + size
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):  # up to the nearest subtree on the right that has a window
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.base:
                k = 2 * k if count[2 * k] else 2 * k + 1
        return k - self.base


def pack_lengths(lengths: list[int], window: int = WINDOW, slack: int = SLACK) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold every token once.

    Full windows of overlong documents come first, then the rest by best-fit decreasing. Windows with more than ``slack``
    tokens free are then filled from the emptiest ones, whose pieces are cut; the last open one is cut at powers of two,
    where a sequence needs no padding.
    """
    out: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int]] = []
    for d, n in enumerate(lengths):
        full = n // window
        out += [[(d, k * window, window)] for k in range(full)]
        if n % window:
            rest.append((n % window, d))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree, bins, free = CapacityTree(window), [], []
    for size, d in rest:
        room = tree.tightest(size)
        if room is None:
            w, room = len(bins), window
            bins.append([])
            free.append(window)
        else:
            w = tree.take(room)
        bins[w].append((d, lengths[d] - size, size))
        free[w] = room - size
        if free[w]:
            tree.put(free[w], w)
    out += [bins[w] for w in range(len(bins)) if free[w] <= slack]
    partial = sorted((w for w in range(len(bins)) if free[w] > slack), key=lambda w: (free[w], w))
    lo, hi = 0, len(partial) - 1
    while lo < hi:  # fill the fullest from the emptiest
        to, giver = bins[partial[lo]], bins[partial[hi]]
        need = free[partial[lo]]
        while need and giver:
            d, start, n = giver.pop()
            if n > need:
                giver.append((d, start, n - need))
                d, start, n = d, start + n - need, need
            to.append((d, start, n))
            need -= n
            free[partial[hi]] += n
        free[partial[lo]] = need
        if not need:
            out.append(to)
            lo += 1
        if not giver:
            hi -= 1
    if lo == hi and bins[partial[lo]]:
        left = bins[partial[lo]]
        total = sum(x[2] for x in left)
        for k in range(window.bit_length(), -1, -1):
            need = total & (1 << k)
            seq = []
            while need:
                d, start, n = left.pop(0)
                if n > need:
                    left.insert(0, (d, start + need, n - need))
                    n = need
                seq.append((d, start, n))
                need -= n
            if seq:
                out.append(seq)
    return out


def _shard(ids: list[bytes], doc_ids: list, first: int, window: int, slack: int) -> tuple[pa.RecordBatch, int]:
    sequences = pack_lengths([len(x) // 4 for x in ids], window, slack)
    cols: list[list] = [[] for _ in range(7)]
    for s, seq in enumerate(sequences):
        at = 0
        for d, start, n in seq:
            crc = zlib.crc32(memoryview(ids[d])[4 * start : 4 * (start + n)])
            for c, v in zip(cols, (doc_ids[d], start, n, crc, len(ids[d]) // 4, first + s, at), strict=True):
                c.append(v)
            at += n
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names), first + len(sequences)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, slack: int = SLACK, shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: where a run of a document's ids lies in which sequence.

    Every input partition packs its own shards of up to ``shard_tokens`` tokens (or one longer document) in one narrow
    pass, so nothing is shuffled or gathered, and a task that runs again gives the same rows. ``sequence_id`` has the partition in its upper bits. A null
    or empty text is one end id; rows with equal or null ids are packed as documents of their own; an empty table gives
    an empty result. Other columns are of no account.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        if tokenizer_path not in _TABLES:
            _TABLES[tokenizer_path] = WordTable(tokenizer_path)
        table, end = _TABLES[tokenizer_path], np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        ids, doc_ids, held = [], [], 0
        for b in cut_batches(batches):
            for doc_id, got in zip(b.column(0).to_pylist(), table.encode_batch(b.column(1).to_pylist()), strict=True):
                ids.append(got + end)
                doc_ids.append(doc_id)
                held += len(got) // 4 + 1
                if held >= shard_tokens:
                    out, sequence = _shard(ids, doc_ids, sequence, window, slack)
                    yield out
                    ids, doc_ids, held = [], [], 0
        if ids:
            yield _shard(ids, doc_ids, sequence, window, slack)[0]

    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return rows.mapInArrow(run, SCHEMA)
