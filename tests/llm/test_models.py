"""Language and toxicity models by held-out accuracy, and the pipeline stage by stage."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import language, shinglejoin, toxicity
from strandloom.llm.common import count_table, drawn, held_out, within
from strandloom.llm.ftrl import Ftrl, softmax, temperature

SF = "/root/testdata/sf0.01"


def test_ftrl_finds_sparse_weights():
    r = np.random.default_rng(1)
    rows = [(np.sort(r.choice(200, 8, replace=False)), np.ones(8)) for _ in range(1500)]
    y = np.array([int((at < 5).any()) for at, _ in rows])
    m, dense = Ftrl(200, 1, l1=8.0).fit(rows, y, 3), Ftrl(200, 1, l1=0.0).fit(rows, y, 3)
    w = m.dense()[:, 0]
    assert (w[:5] > 0.5).all() and (w[5:200] == 0).mean() > 0.5 and (dense.dense()[5:200, 0] == 0).mean() < 0.1
    p = m.scores(rows)[:, 0] > 0
    assert (p == (y == 1)).mean() > 0.97


def test_temperature_of_overconfident_scores():
    r = np.random.default_rng(2)
    z = r.standard_normal((4000, 3))
    y = np.array([r.choice(3, p=p) for p in softmax(z)])
    assert abs(temperature(3 * z, y) - 3) < 0.4


def test_count_table(spark):
    def counts(batches):
        out = np.zeros(100_000, np.int64)
        for b in batches:
            np.add.at(out, b.column(0).to_numpy(), 1)
        return out

    got = count_table(spark.range(0, 300_000, 1, 70).select((F.col("id") % 100_000).alias("k")), counts, 100_000)
    assert (got == 3).all()


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    acc, n, low, high = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 200 and acc > 0.95 and 0 <= low and high <= 1
    assert out.where(F.col("held_out") != held_out()).count() == 0


def test_language_of_odd_rows(spark):
    texts = [(1, "the cat sat on the mat", "en"), (2, "le chat est sur la table", "fr"), (3, None, "en"), (4, "", None), (5, "123 ... !!", "fr"), (None, "the dog", None), (6, "the " * 60000, "en"), (6, "the cat", "en")]
    docs = spark.createDataFrame([(*t, 1.0, "x") for t in texts], "doc_id long, text string, lang string, score double, lang_pred string")
    got = language.identify(docs).collect()
    assert len(got) == len(texts)
    und = {x["doc_id"] for x in got if x["lang_pred"] == "und"}
    assert und >= {3, 4, 5} and all(x["lang_pred"] in ("en", "fr", "und") for x in got)
    assert language.identify(docs.limit(0)).count() == 0
    assert {x["lang_pred"] for x in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_languages_of_long_texts_are_learned(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    en, fr = "the cat sat on the mat with another dog ", "le chat est assis sur la table avec un chien "
    rows = [(k, en * 3, "en") for k in range(40)] + [(k, fr * (300 + k), "fr") for k in range(40, 60)] + [(k, fr * 2, "fr") for k in range(100, 130) if zlib.crc32(str(k).encode()) % 3 == 1]
    docs = spark.createDataFrame([(*r, "s", len(r[1])) for r in rows], schema)
    assert all(x["lang_pred"] == x["lang"] for x in language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect())
    books = spark.createDataFrame([(*r, "s", len(r[1])) for r in rows if r[2] == "fr" and len(r[1]) > 10_000] + [(200, "12 34", "fr", "s", 5)], schema)
    assert {x["lang_pred"] for x in language.identify(books).where("doc_id < 200").collect()} == {"fr"}
    assert corpus_pipeline.keep_known_language(spark, books, "").count() == books.count() - 1
    unlabelled = books.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.keep_known_language(spark, unlabelled, "").count() == books.count() - 1


def test_a_language_with_one_row_is_learned(spark):
    docs = spark.createDataFrame([(k, "the cat sat on the mat", "en") for k in (0, 1, 2, 3)] + [(4, "der Hund schläft", "de")], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.languages == ["de", "en"] and model.predict("der Hund schläft")[0] == "de"


def test_drawn_rows_have_any_length(spark):
    rows = spark.range(0, 20_000).select((F.col("id") % 3).cast("string").alias("k"), "id", F.xxhash64("id").alias("draw")).where("k <> '2' or id < 12")
    rows = rows.unionByName(rows.where("id < 300"))
    found = {r["k"]: r["count"] for r in rows.groupBy("k").count().collect()}
    got = drawn(rows, "k", {"0": 50, "1": 20, "2": 30}, found).collect()
    for k, n, most in (("0", 50, 140), ("1", 20, 90), ("2", 4, 4)):
        draws = sorted({r["draw"] for r in rows.where(F.col("k") == k).select("draw").collect()})
        mine = sorted(r["draw"] for r in got if r["k"] == k)
        assert n <= len(mine) <= most and mine == draws[: len(mine)]
    few = spark.createDataFrame([("a", d, 10) for d in range(0, 100)] + [("b", 1, 900), ("c", 1, 5), ("c", 9, 5)], "k string, draw long, cells long")
    kept = sorted((r["k"], r["draw"]) for r in within(few, "k", 60).collect())
    assert kept == [("a", d) for d in range(6)] + [("b", 1), ("c", 1), ("c", 9)]


def test_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    spoilt = docs.withColumn("lang", F.when(held_out(), F.lit("zz")).otherwise(F.col("lang")))
    a, b = (sorted(map(str, language.identify(d).collect())) for d in (docs, spoilt))
    assert a == b


def test_toxicity(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    train, rest = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    out = toxicity.rate_toxicity(docs, train).join(rest.select("doc_id", F.col("toxic").alias("label")), "doc_id")
    fp, fn, n = out.agg(F.count_if(F.col("toxic") & (F.col("label") == 0)), F.count_if(~F.col("toxic") & (F.col("label") == 1)), F.count("*")).first()
    assert n > 50 and fp <= 0.03 * n and fn <= 0.08 * n


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "you idiot", 1), (2, None, 1), (3, "", 0), (None, "nice", 0), (1, "you idiot", 1), (4, "fine day", 1), (5, "idiot " * 40000, 1)], "doc_id long, text string, p_toxic int")
    labels = spark.createDataFrame([(1, 0, 1), (4, 1, 0), (4, None, 0), (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.rate_toxicity(docs, labels).collect()
    assert len(got) == 7 and all(0 <= x["p_toxic"] <= 1 for x in got)
    assert not any(x["toxic"] for x in toxicity.rate_toxicity(docs, labels.limit(0)).collect())
    assert toxicity.rate_toxicity(docs.limit(0), labels).count() == 0


def test_toxic_rows_are_found_in_long_documents(spark):
    bad, fine = "vile scum idiot trash ", "a calm and pleasant day by the sea "
    texts = [(k, bad * (1000 + k) if k % 4 == 0 else fine * 3) for k in range(120)] + [(200, bad * 4), (201, fine)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(120)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x["toxic"] for x in toxicity.rate_toxicity(docs, labels).collect()}
    assert got == {k: "vile" in t for k, t in texts}
    assert toxicity.fit(docs, labels).weights[list(toxicity.buckets("idiot")), 1].sum() > 0


def test_labels_of_missing_documents_take_no_places(spark):
    bad, fine = "vile scum idiot trash ", "a calm and pleasant day by the sea "
    texts = [(k, bad if k % 4 == 0 else fine) for k in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.range(0, 3_000_000).selectExpr("id as doc_id", "1 as quality", "cast(id % 4 = 0 as int) as toxic")
    got = {x["doc_id"]: x["toxic"] for x in toxicity.rate_toxicity(docs, labels).collect()}
    assert got == {k: "vile" in t for k, t in texts}


def test_chain_feeds_earlier_probabilities():
    r = np.random.default_rng(4)
    rows = [(k, np.array([k % 2, 2 + int(r.integers(5))]), np.ones(2)) for k in range(600)]
    y = np.array([[k % 2, k % 2] for k, *_ in rows])
    chain = toxicity.train(rows, y, ["a", "b"], l1=0.1)
    assert chain.links[1, 0] > 0 and chain.links[0].any() == False  # noqa: E712
    p = chain.chained(np.array([[x[1].sum() * 0.0 for _ in range(2)] for x in rows]))
    assert p.shape == (600, 2)


def brute_pipeline(rows, labels, model, chain, tokenizer):
    """run() in plain Python, given the two trained models: (doc_id -> number of rows packed, ids of each)."""
    import re

    from strandloom.llm.language import grams

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    def known(text):
        g = grams(text)
        return g is not None and sum(model.place[k] > 0 for k in g.tolist()) >= model.floor * len(g)

    def toxic(text):
        z = []
        for c in range(len(chain.categories)):
            s = chain.bias[c] + sum(chain.weights[k, c] for w in toxicity.words(text) for k in toxicity.buckets(w))
            z.append(s + sum(chain.links[c, e] * toxicity.log_odds(np.array([1 / (1 + np.exp(-z[e]))]))[0] for e in range(c)))
        return 1 / (1 + np.exp(-z[-1])) >= chain.threshold

    rows = [r for r in rows if known(r[1])]
    clean = [r for r in rows if not toxic(r[1])]
    sets, parent = [shingles(r[1]) for r in clean], list(range(len(clean)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(clean)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    first = {}
    for k, r in enumerate(clean):
        key = (r[0] is not None, r[0] or 0, k)
        first[find(k)] = min(first.get(find(k), key), key)
    kept = [clean[k[2]] for k in first.values()]
    return rows, clean, kept, sorted((str(r[0]), len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1) for r in kept)


def odd_corpus():
    """Rows of documents with copies, near copies, toxic and foreign texts, nulls, and repeated ids."""
    import random

    r = random.Random(11)
    en, fr = "the of and to in that it was with for as his on be at by".split(), "le la et les des en un une du que dans qui par pour sur pas".split()
    nouns = [f"{a}{b}" for a in ("ston", "mar", "bel", "tor", "win") for b in ("er", "ing", "al", "ette", "on")]
    rows = []
    for k in range(160):
        words = [r.choice(en if k % 2 else fr) if r.random() < 0.6 else r.choice(nouns) for _ in range(r.choice([12, 40, 90]))]
        if k % 5 == 0:
            words += [r.choice(["scumbag", "vermin", "lowlife"]) for _ in range(4)]
        rows.append((k, " ".join(words), "en" if k % 2 else "fr", "s", 1))
    near = rows[31][1].split()
    near[-1] = "changed"
    same = next(x for x in rows if len(x[1].split()) == 90 and x[0] % 5)
    rows += [(500, same[1], None, "s", 1), (501, same[1].upper(), None, "s", 1), (same[0], same[1], "en", "t", 2), (605, " ".join(near), None, "s", 1)]
    rows += [(7, "quite another text with the same number in it and of that", "en", "s", 1), (None, rows[9][1], "en", "s", 1), (None, "no number but the words of it", None, "s", None)]
    rows += [(600, None, "en", "s", 1), (601, "", None, None, None), (602, "12 34 56", "fr", "s", 1), (603, "\u8fd9\u662f\u4e2d\u6587\u53e5\u5b50" * 20, None, "s", 1), (604, "the and of " * 20_000, "en", "s", 1)]
    labels = [(k, int(k % 3 != 0), int(k % 5 == 0)) for k in range(160) if k % 4]
    return rows, labels


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_against_plain_python(spark, tmp_path, monkeypatch):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import public_tokenizers
    from tokenizers import Tokenizer

    rows, labels = odd_corpus()
    spark.createDataFrame(rows, DOCUMENTS).withColumn("row_", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    models, stages = {}, {}
    for kind in (language, toxicity):
        def keep(*args, fit=kind.fit, name=kind.__name__, **kw):
            models[name] = fit(*args, **kw)
            return models[name]

        monkeypatch.setattr(kind, "fit", keep)
    materialize = corpus_pipeline.materialize

    def written(df, tag):
        stages[tag] = materialize(df, tag)
        return stages[tag]

    monkeypatch.setattr(corpus_pipeline, "materialize", written)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    model, chain = models["strandloom.llm.language"], models["strandloom.llm.toxicity"]
    assert 0 < model.floor < 1 and 0 < chain.threshold < 1
    known, clean, kept, packed = brute_pipeline(rows, labels, model, chain, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    for name, want in (("language", known), ("toxicity", clean), ("near_duplicates", kept)):
        got = stages[f"pipeline-{name}"]
        assert got.columns == list(corpus_pipeline.COLUMNS)
        cols = 2 if name == "near_duplicates" else 5  # of rows with one id and text, either stays
        assert sorted(str(tuple(r)[:cols]) for r in got.collect()) == sorted(str(r[:cols]) for r in want), name
    assert {603, 602, 601, 600}.isdisjoint(r[0] for r in known) and {None, 604} <= {r[0] for r in known}
    assert {r[0] for r in known} - {r[0] for r in clean} <= set(range(0, 160, 5)) and len(clean) < len(known)
    assert len([r for r in kept if r[0] == 7]) == len([r for r in clean if r[0] == 7]) and len(kept) < len(clean)
    assert len(kept) == len({r[:2] for r in kept})
    got = sorted((str(p["doc_id"]), p["doc_tokens"]) for p in pieces if p["start"] == 0)
    assert got == packed
    taken = {}
    for p in pieces:
        taken[p["sequence_id"]] = taken.get(p["sequence_id"], 0) + p["length"]
    assert sum(taken.values()) == sum(n for _, n in packed) and max(taken.values()) <= 2048


def test_pipeline_stages_on_odd_tables(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows, _ = odd_corpus()
    docs = spark.createDataFrame(rows, DOCUMENTS).withColumns({"lang_pred": F.lit(1), "p_toxic": F.lit("x"), "component_id": F.lit(2), "score": F.lit("y")})
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert name == "packing" or got.columns == list(corpus_pipeline.COLUMNS)
        assert got.count() > 0 and stage(spark, docs.limit(0), SF).count() == 0
    nothing = docs.withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long"))
    assert [stage(spark, nothing, SF).count() for _, stage in corpus_pipeline.STAGES] == [0, len(rows), len(rows), len(rows)]


def test_repeated_ids_lose_no_text(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c = "one two three four five six seven", "eight nine ten eleven twelve thirteen", "quite another text that nothing here resembles"
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (5, b, "en", "s", 1), (2, a, "en", "s", 1), (2, c, "en", "s", 1)]
    got = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, DOCUMENTS), SF)
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(1, a), (2, c), (5, b)]


def test_threshold_has_the_least_cost():
    p, y = np.array([0.1, 0.2, 0.3, 0.6, 0.9, 0.95]), np.array([0, 0, 1, 0, 1, 1])
    assert 0.2 < toxicity.best_threshold(p, y, (1.0, 5.0)) < 0.3 and 0.6 < toxicity.best_threshold(p, y, (5.0, 1.0)) < 0.9
    assert toxicity.best_threshold(p, np.zeros(6), (1.0, 1.0)) == toxicity.NEVER


def test_every_labelled_document_is_learned_from(spark, monkeypatch):
    """Over several shards all rows count in the model and in the threshold, and no row comes to the driver."""
    calm = "a calm and pleasant day by the sea "
    texts = [(k, calm + f"w{k}" + (" vermin" if k % 3 == 0 else "")) for k in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(300)], "doc_id long, quality int, toxic int")
    judged = []
    best = toxicity.best_threshold
    monkeypatch.setattr(toxicity, "best_threshold", lambda p, y, cost, n=None: judged.append((int(n[y == 1].sum()), int(n.sum()), cost)) or best(p, y, cost, n))
    monkeypatch.setattr(toxicity, "train", lambda *a, **kw: pytest.fail("rows came to the driver"))
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 90)
    chain = toxicity.fit(docs, labels, driver_rows=100)
    assert judged == [(100, 300, (1.0, 1.0))]
    assert chain.weights[list(toxicity.buckets("vermin")), 1].sum() > 0
    told = chain.predict([t for _, t in texts])[:, 1] >= chain.threshold
    assert told.tolist() == [k % 3 == 0 for k, _ in texts]


def test_one_shard_is_the_chain_of_the_driver(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(150), spark.read.parquet(f"{SF}/labels.parquet")
    here, apart = toxicity.fit(docs, labels), toxicity.fit(docs, labels, driver_rows=0)
    assert here.weights.any() and np.allclose(here.weights, apart.weights, atol=1e-4)
    assert np.allclose(here.bias, apart.bias, atol=1e-4) and np.allclose(here.links, apart.links, atol=1e-4)


def test_copies_share_a_fold(spark):
    texts = [(k, f"word{k % 7} and more words{k % 7}") for k in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(60)], "doc_id long, quality int, toxic int")
    seen = []
    train = toxicity.train
    try:
        toxicity.train = lambda rows, *a, **kw: seen.extend(rows) or train(rows, *a, **kw)
        toxicity.fit(docs, labels)
    finally:
        toxicity.train = train
    assert len(seen) == 60 and len({(r[0], r[1].tobytes()) for r in seen}) == 7


def test_language_model_against_plain_numpy(spark):
    """The document frequencies, weights, temperature and scores again, without Spark and with dense arrays."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs.select("doc_id", "text", "lang"))
    rows = docs.where("lang is not null").select("text", "lang", F.xxhash64("doc_id", "text", "lang").alias("draw")).collect()
    rows = sorted(((r["draw"], r["lang"], language.grams(r["text"])) for r in rows if language.grams(r["text"]) is not None), key=lambda r: r[0])
    size = 1 << language.BITS
    df = np.zeros(size)
    for _, _, g in rows:
        df[np.unique(g)] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    names = sorted({r[1] for r in rows})
    assert model.languages == names and len(rows) < language.SAMPLE_ROWS
    x = [np.bincount(g, minlength=size) / len(g) * idf * language.SCALE for _, _, g in rows]
    y = np.array([names.index(r[1]) for r in rows])
    held = np.array([zlib.crc32(np.unique(g).astype(np.uint32).tobytes()) % language.CALIBRATE == 0 for _, _, g in rows])
    learn = np.flatnonzero(~held)
    z, n = np.zeros((size + 1, len(names))), np.zeros((size + 1, len(names)))
    order = np.random.default_rng(7)

    def weights(at):
        return -np.sign(z[at]) * np.maximum(np.abs(z[at]) - 0.02, 0) / ((1 + np.sqrt(n[at])) / 0.5 + 1e-3)

    for _ in range(language.EPOCHS):
        for k in order.permutation(len(learn)):
            at = np.append(np.flatnonzero(x[learn[k]]), size)
            v = np.append(x[learn[k]], 1.0)[at]
            w = weights(at)
            g = v[:, None] * (softmax(v @ w) - np.eye(len(names))[y[learn[k]]])
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / 0.5 * w
            n[at] += g * g
    w = weights(slice(None))
    scores = np.array([np.append(v, 1.0) @ w for v in x])
    t = temperature(scores[held], y[held])
    assert abs(t - model.t) < 1e-2 * t
    p = softmax(scores / t)
    for k in range(0, len(rows), 7):
        lang, score, _ = model.predict(docs.where(F.xxhash64("doc_id", "text", "lang") == rows[k][0]).first()["text"]) if k < 35 else (names[p[k].argmax()], p[k].max(), 0)
        assert lang == names[p[k].argmax()] and abs(score - p[k].max()) < 1e-3


def plain_ftrl(x, y, epochs, l1, l2=1e-3, alpha=0.5):
    """Weights of dense rows (the bias last) by the update rule, coordinate by coordinate."""
    z, n = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    rows, order = np.hstack([x, np.ones((len(x), 1))]), np.random.default_rng(7)
    weights = lambda: -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((1 + np.sqrt(n)) / alpha + l2)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            w = weights()
            g = rows[k] * (1 / (1 + np.exp(-np.clip(rows[k] @ w, -40, 40))) - y[k])
            z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / alpha * w
            n += g * g
    return weights()


def test_chain_training_against_plain_numpy():
    """The whole chain again: both models, the out-of-fold probabilities that feed the second, and the threshold."""
    r = np.random.default_rng(12)
    n, words = 240, 30
    x = (r.random((n, words)) < 0.2).astype(float)
    low = (x[:, 0] + x[:, 1] > 0).astype(int)
    toxic = ((x[:, 2] + low + (r.random(n) < 0.1)) >= 2).astype(int)
    low[::17] = -1  # unknown
    fold = r.integers(0, 50, n)
    rows = [(int(f), np.flatnonzero(v).astype(np.int32), v[v > 0]) for f, v in zip(fold, x, strict=True)]
    chain = toxicity.train(rows, np.stack([low, toxic], axis=1), ["low", "toxic"], l1=0.3, cost=(2.0, 5.0))
    extra = np.zeros((n, 0))
    for c, y in enumerate((low, toxic)):
        both = np.hstack([x, extra])
        know = y >= 0
        w = plain_ftrl(both[know], y[know], toxicity.EPOCHS, 0.3)
        assert np.allclose(chain.weights[:words, c], w[:words], atol=1e-6) and np.isclose(chain.bias[c], w[-1], atol=1e-6)
        assert np.allclose(chain.links[c, :c], w[words:-1], atol=1e-6)
        p = np.zeros(n)
        for f in range(toxicity.FOLDS):
            out = fold % toxicity.FOLDS == f
            w = plain_ftrl(both[know & ~out], y[know & ~out], toxicity.EPOCHS, 0.3)
            p[out] = 1 / (1 + np.exp(-np.clip(np.hstack([both, np.ones((n, 1))])[out] @ w, -40, 40)))
        extra = np.hstack([extra, toxicity.log_odds(p)[:, None].astype(np.float32)])
    cost = lambda t: 2.0 * ((p >= t) & (toxic == 0)).sum() + 5.0 * ((p < t) & (toxic == 1)).sum()
    assert cost(chain.threshold) <= min(cost(t) for t in [0.0, *np.unique(p), 1.1]) + 1e-9
    assert abs(chain.links[1, 0]) > 0


def test_many_words_of_one_beginning_count_alike(spark):
    """A bucket with 600 words counts 600 in training, as in prediction."""
    texts = [(k, " ".join(f"urls{i}x{k}" for i in range(600)) + (" vermin" if k % 2 else "")) for k in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    seen, train = [], toxicity.train
    try:
        toxicity.train = lambda rows, *a, **kw: seen.extend(rows) or train(rows, *a, **kw)
        toxicity.fit(docs, labels)
    finally:
        toxicity.train = train
    place = toxicity.buckets("urls0x0")[1]
    want = {k: sum(b == place for w in toxicity.words(t) for b in toxicity.buckets(w)) for k, t in texts}
    assert sorted(int(n[list(at).index(place)]) for _, at, n in seen) == sorted(want.values()) and min(want.values()) >= 600


def test_a_rare_label_more_changes_no_bucket(spark):
    """300 languages are learned with the same hashes as three."""
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}q{chr(0x100 + k)}" for k in range(300)]
    texts = [(k * 10 + j, " ".join([words[k]] * (5 + j)), f"l{k:03d}") for k in range(300) for j in range(3)]
    model = language.fit(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    assert len(model.languages) == 300 and len(model.place) == 1 << language.BITS
    assert np.mean([model.predict(t)[0] == lang for _, t, lang in texts]) > 0.9


def test_a_run_is_cut_and_hashed_once(monkeypatch):
    """A worker's tables give the features of every text, and no run between white space is looked at twice."""
    texts = ["A b, b. (b) c!", None, "", "...", "B c c; d", "A b, b. (b) c!", "d ... a"] * 3
    want = [np.unique([k for w in toxicity.words(t) for k in toxicity.buckets(w)], return_counts=True) for t in texts]
    asked, real = [], toxicity.buckets
    monkeypatch.setattr(toxicity, "buckets", lambda w: asked.append(w) or real(w))
    seen = toxicity.Words()
    got = [seen.features(t) for t in texts]
    assert all(np.array_equal(g[0], w[0]) and np.array_equal(g[1], w[1]) for g, w in zip(got, want, strict=True))
    assert sorted(asked) == ["a", "b", "c", "d"]
    monkeypatch.setattr(toxicity, "TABLE_ROWS", 2)
    assert all(np.array_equal(seen.features(t)[0], w[0]) for t, w in zip(texts, want, strict=True))


def test_models_of_folds_learn_from_rows_placed_once():
    """A model over the coordinates of all rows, of which it sees some, is the model of these rows alone."""
    r = np.random.default_rng(3)
    rows = [(np.sort(r.choice(60, 6, replace=False)), r.integers(1, 4, 6).astype(float)) for _ in range(200)]
    y, some = np.array([int((at < 9).any()) for at, _ in rows]), np.arange(0, 200, 2)
    order = some[np.random.default_rng(7).permutation(100)]
    every, alone = Ftrl(60, 1, l1=1.0).hold(rows), Ftrl(60, 1, l1=1.0).fit([rows[k] for k in some], y[some], 1)
    placed = [every.placed(*row, np.float32) for row in rows]
    every.learn_placed(every.z[:, 0], every.n[:, 0], (placed[k] for k in order), y[order].tolist())
    assert alone.dense().any() and np.allclose(every.dense(), alone.dense(), atol=1e-12)


def test_no_row_copies_the_states(spark, monkeypatch):
    """The states that a shard learns from are contiguous: NumPy takes from any other array by copying all of it, row by row."""
    docs = spark.createDataFrame([(k, f"word{k % 7} and more words{k}") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(60)], "doc_id long, quality int, toxic int")
    seen, real, learn = [], toxicity.count_table, Ftrl.learn_placed
    here = lambda rows, counts, size, kind="int64": np.asarray(counts(rows.toArrow().to_batches()), kind) if "shard" in rows.columns else real(rows, counts, size, kind)
    monkeypatch.setattr(toxicity, "count_table", here)
    monkeypatch.setattr(Ftrl, "learn_placed", lambda self, z, n, *a: seen.append((z.flags.c_contiguous, n.flags.c_contiguous)) or learn(self, z, n, *a))
    toxicity.fit(docs, labels, driver_rows=0)
    assert len(seen) == 2 * toxicity.EPOCHS * (toxicity.FOLDS + 1) and set(seen) == {(True, True)}


def test_prediction_keeps_beginnings_not_runs(monkeypatch):
    """Scores are those of the distinct words' buckets, a beginning is hashed once, and what comes once leaves nothing behind."""
    r = np.random.default_rng(5)
    weights = np.where(r.random((1 << toxicity.BITS, 2)) < 0.5, r.normal(size=(1 << toxicity.BITS, 2)), 0)
    texts = [" ".join(f"urls{k}x{i}, urls{k}x{i}" for i in range(200)) for k in range(20)] + [None, "", "... !", "a\ud800b ß"]
    want = [np.sum([weights[k] for w in toxicity.words(t) for k in toxicity.buckets(w)] or [[0, 0]], axis=0) for t in texts]
    asked, real = [], toxicity.buckets
    monkeypatch.setattr(toxicity, "buckets", lambda w: asked.append(w) or real(w))
    chain = toxicity.Chain(["a", "b"], weights, np.array([0.1, -0.2]), np.array([[0.0, 0.0], [0.3, 0.0]]))
    got = chain.predict(texts)
    assert np.allclose(got, chain.chained(np.array(want) + [0.1, -0.2]), atol=1e-9)
    assert sorted(asked) == sorted({w[: toxicity.PREFIX] for t in texts for w in toxicity.words(t)})
