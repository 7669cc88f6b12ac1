"""SentencePiece encoding and decoding through a table of distinct chunks.

A piece of the vocabulary never has the whitespace marker after another character, so a text falls into chunks (markers,
then other characters) that are segmented independently. Each distinct chunk of a worker's table is encoded and decoded
once by the library; the texts' ids are the chunks' ids joined by position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from strandloom.llm.common import bounded_batches
from strandloom.llm.common import cut as cut_batches

MARK = "▁"
#: Entries of a worker's chunk table before it starts anew; bounds memory, never the result.
TABLE_ROWS = 400_000

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_TABLES: dict[tuple[str, int], ChunkTable] = {}


class ChunkTable:
    """Distinct chunk -> (number of ids, ids as text, decoded text)."""

    def __init__(self, model_path: str, limit: int = TABLE_ROWS):
        import sentencepiece as spm

        self.sp = spm.SentencePieceProcessor(model_file=model_path)
        self.limit, self.rows = limit, {}
        self.eos = self.sp.eos_id()
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of this vocabulary crosses a whitespace marker")
        if self.sp.encode("  a ") != [*self.sp.encode("  a"), *self._tail(1)] or self.sp.decode(self.sp.encode(" a  b ")) != " a  b ":
            raise ValueError("this model changes whitespace; chunks can't be cut from the text")

    def _tail(self, n: int) -> list[int]:
        """The ids of ``n`` markers at the end of a text."""
        head = self.sp.encode("a")
        return self.sp.encode("a" + " " * n)[len(head) :]

    @staticmethod
    def cut(text: str) -> tuple[list[str], int]:
        """The chunks (each without its first marker) and the number of markers at the end; '' between blanks adds a marker."""
        parts = text.split(" ")
        if "" not in parts:
            return parts, 0
        chunks, blank = [], 0
        for p in parts:
            if p:
                chunks.append(" " * blank + p)
                blank = 0
            else:
                blank += 1
        return chunks, blank

    def learn(self, chunks: set[str]) -> None:
        """Segment each chunk that the table lacks, once."""
        if len(self.rows) > self.limit:
            self.rows.clear()
        new = list(chunks.difference(self.rows))
        if new:
            ids = self.sp.encode(new, num_threads=1)
            for c, i, d in zip(new, ids, self.sp.decode(ids, num_threads=1), strict=True):
                self.rows[c] = (len(i), " ".join(map(str, i)), d)

    def whole(self, text: str) -> tuple[int, str, str]:
        ids = self.sp.encode(text)
        return len(ids), " ".join(map(str, ids)), self.sp.decode(ids)

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, ids as text, decoded text) of each text, without an end id."""
        for at in range(0, len(texts), 256):  # the table is looked at between groups, so that it stays near its limit
            group = [t or "" for t in texts[at : at + 256]]
            cuts = [None if MARK in t or not t.strip(" ") else self.cut(t) for t in group]
            self.learn(set().union(*(cut[0] for cut in cuts if cut)))
            for text, cut in zip(group, cuts, strict=True):
                if cut is None:
                    yield self.whole(text)
                    continue
                found = [self.rows[c] for c in cut[0]]
                n, ids, decoded = sum(f[0] for f in found), " ".join([f[1] for f in found]), " ".join([f[2] for f in found])
                if cut[1]:
                    tail = self._tail(cut[1])
                    n, ids, decoded = n + len(tail), " ".join([ids, *map(str, tail)]), decoded + " " * cut[1]
                yield n, ids, decoded


def _table(model_path: str, limit: int) -> ChunkTable:
    if (model_path, limit) not in _TABLES:
        _TABLES[model_path, limit] = ChunkTable(model_path, limit)
    return _TABLES[model_path, limit]


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", table_rows: int = TABLE_ROWS, digest: bool = False) -> DataFrame:
    """Ids (with an end id) and decoded text of every whole text, or with ``digest`` their SHA-256.

    One narrow pass: no shuffle, so no key can be hot, and a lost task is simply run again. A null text counts as empty
    (the end id alone); an empty table gives an empty result; repeated rows and columns other than the two named are of no
    account. Memory is bounded by ``table_rows`` chunks, plus one batch of texts, for each Python worker.
    """
    cols = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model_path, table_rows)
        eos, only = f" {table.eos}", str(table.eos)
        for b in cut_batches(batches):
            n, ids, decoded = [], [], []
            for k, text_ids, text in table.encode_batch(b.column(1).to_pylist()):
                line = text_ids + eos if k else only
                n.append(k + 1)
                ids.append(hashlib.sha256(line.encode()).hexdigest() if digest else list(map(int, line.split())))
                decoded.append(hashlib.sha256(text.encode()).hexdigest() if digest else text)
            kinds = [pa.int64(), pa.string(), pa.string()] if digest else [pa.int64(), pa.list_(pa.int32()), pa.string()]
            names = ["n_tokens", *(c.split()[0] for c in cols.split(", "))]
            out = [b.column(0), *(pa.array(v, k) for v, k in zip((n, ids, decoded), kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", *names])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return rows.mapInArrow(run, f"doc_id long, n_tokens long, {cols}")
