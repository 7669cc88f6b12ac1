"""Piece encoding and packing against the libraries on whole texts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm.packing import WordTable, pack_documents, pack_lengths
from strandloom.llm.pieces import ChunkTable, encode_pieces

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "   ", "a", " a", "a ", "  a  b  ", "x\n\ny z", "▁a b", "\x00a b\x1c c", "İstanbul İ", "it's he'll 12.5% <|endoftext|> x", "éa café ́x", "中文 字 テ", "🙂🙂 a🙂",
    "\xa0a\xa0b", "A​B   c", "ὈΔΥΣΣΕΎΣ ΣΑΣ", "क़ x", "x ,. a_. _, b", "a.'s ,'t b", "a.b,c...  !!! ?..", "'s 's's don't", "ǅ ß ﬁ ﬀa", "long " * 30000, "x" * 5000,
]


@pytest.fixture(scope="module")
def chunk_table():
    return ChunkTable(PIECES, limit=50)


@pytest.fixture(scope="module")
def word_table():
    return WordTable(WORDS, word_rows=50)


def test_odd_texts(chunk_table, word_table):
    for text, (n, ids, decoded) in zip(ODD, chunk_table.encode_batch(ODD), strict=True):
        want = chunk_table.sp.encode(text)
        assert (n, ids, decoded) == (len(want), " ".join(map(str, want)), chunk_table.sp.decode(want))
    for text, got in zip(ODD, word_table.encode_batch(ODD), strict=True):
        assert got == word_table.whole(text), text[:50]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abAB éÉ.,;'’-_ \n\t09ΣßİÅ中🙂▁*"), max_size=40), max_size=5))
def test_random_texts(chunk_table, word_table, texts):
    for text, (n, ids, decoded) in zip(texts, chunk_table.encode_batch(texts), strict=True):
        want = chunk_table.sp.encode(text)
        assert (n, ids, decoded) == (len(want), " ".join(map(str, want)), chunk_table.sp.decode(want))
    for text, got in zip(texts, word_table.encode_batch(texts), strict=True):
        assert got == word_table.whole(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 700), max_size=60), st.sampled_from([16, 64, 100]))
def test_packing_holds_every_token_once(lengths, window):
    seqs = pack_lengths(lengths, window, slack=2)
    at = {}
    for d, start, n in sorted(p for s in seqs for p in s):
        assert n > 0 and start == at.get(d, 0)
        at[d] = start + n
    assert [at.get(d, 0) for d in range(len(lengths))] == lengths
    sizes = [sum(p[2] for p in s) for s in seqs]
    assert all(x <= window for x in sizes)
    pads = [window - x for x in sizes if x < window and x & (x - 1)]
    assert all(p <= 2 for p in pads), "only slack is padded"


def test_tightest_window_is_taken():
    seqs = pack_lengths([60, 50, 40, 50], 100, slack=0)
    assert sorted(sorted(p[0] for p in s) for s in seqs) == [[0, 2], [1, 3]]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, start string, n_tokens int")


def test_queries_over_odd_rows(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "null id"), (3, "again"), (3, "again"), (99, None)]
    got = sorted(map(tuple, encode_pieces(frame(spark, rows), PIECES, digest=True).collect()), key=str)
    sp = ChunkTable(PIECES).sp
    want = []
    for i, t in rows:
        ids = sp.encode(t or "") + [sp.eos_id()]
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    full = encode_pieces(frame(spark, [(1, "ab cd")]), PIECES).first()
    assert list(full["ids"]) == sp.encode("ab cd") + [sp.eos_id()] and full["decoded"] == "ab cd"

    table = WordTable(WORDS)
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(np.frombuffer(table.whole(t or ""), "<u4").tolist() + [1])
    pieces = pack_documents(frame(spark, rows), WORDS).collect()
    assert sum(p["length"] for p in pieces) == sum(len(x) for v in ids.values() for x in v)
    for p in pieces:
        cut = lambda x, p=p: x[p["start"] : p["start"] + p["length"]]
        assert any(len(x) == p["doc_tokens"] and zlib.crc32(np.array(cut(x), "<u4").tobytes()) == p["ids_crc32"] for x in ids[p["doc_id"]])
    by_seq = {}
    for p in pieces:
        by_seq.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048


def test_empty_tables(spark):
    none = frame(spark, [])
    assert pack_documents(none, WORDS).count() == 0 and encode_pieces(none, PIECES).count() == 0


def test_small_shards_pad_little(spark):
    r = random.Random(1)
    rows = [(k, " ".join(r.choices(["the", "cat", "sat"], k=r.randrange(1, 900)))) for k in range(300)]
    pieces = pack_documents(frame(spark, rows), WORDS, shard_tokens=20_000).collect()
    size = {}
    for p in pieces:
        size[p["sequence_id"]] = size.get(p["sequence_id"], 0) + p["length"]
    pad = sum(2048 - n for n in size.values() if n & (n - 1))
    assert pad < 0.01 * sum(size.values())
