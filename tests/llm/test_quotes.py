"""Quotation linking against its SQL, on hand-made threads."""

import oracle
import pandas as pd

from strandloom.llm import quotes

ROWS = [
    (1, 0, "u", "Hello there my friend\nHow are you today?"), (1, 1, "a", "On Monday u wrote:\n> Hello there my friend\n> How are you\n> today?\n\nI am fine thank you"),
    (1, 2, "u", ">> How are you today?\n> I am fine thank you\nGreat news indeed"), (1, 3, "a", "Another topic entirely"), (1, 4, "u", "> Great news   indeed\nok"), (1, 5, "x", "> > I am fine thank you\nnot level one"),
    (2, 0, "u", None), (2, 1, "a", ""), (None, 1, "a", "x"), (2, None, "a", "> q q q q q q"), (1, 3, "a", "Another topic entirely"), (3, 0, "u", "> unknown quote here\r\nyes"),
    (3, 2000, "u", "something said long ago"), (3, 5000, "u", "> something said long ago"), (3, 5001, "u", "> something said long ago\nsomething said long ago"), (3, 5002, "u", ">something said long ago"),
    *((4, k, "u", f"> line number {k - 1} here\nline number {k} here" if k else "line number 0 here") for k in range(40)), (5, 0, "u", "> " * 3000 + "deep\n" + "w " * 50000),
]


def test_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(ROWS, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    df = spark.createDataFrame([(*r, "x", 3) for r in ROWS], "conv_id long, turn long, role string, text string, thread string, lines int")
    got = quotes.link_quotes(df)
    assert oracle.compare(got, con, quotes.SQL) == ""
    chain = {x["turn"]: (x["reply_to"], x["thread"], x["depth"]) for x in got.where("conv_id = 4").collect()}
    assert chain[39] == (38, 0, 39) and chain[0] == (None, 0, 0)


def test_empty_table(spark):
    assert quotes.link_quotes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_small_buckets_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame([r for r in ROWS if r[0] in (1, 3, 4)], "conv_id long, turn long, role string, text string")
    a = sorted(map(str, quotes.link_quotes(df).collect()))
    monkeypatch.setattr(quotes, "BUCKET", 3)
    assert sorted(map(str, quotes.link_quotes(df).collect())) == a


def test_short_passages_link(spark):
    rows = [(1, 0, "a", "Shall we?"), (1, 1, "b", "Yes."), (1, 2, "a", "> Yes.\n\n42"), (1, 3, "b", "> 42\nwhy"), (1, 4, "a", "> 好\nwho said so"), (1, 5, "b", "x")]
    got = {x["turn"]: (x["reply_to"], x["n_passages"], x["n_linked"]) for x in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: (None, 0, 0), 1: (None, 0, 0), 2: (1, 1, 1), 3: (2, 1, 1), 4: (None, 1, 0), 5: (None, 0, 0)}
