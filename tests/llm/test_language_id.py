import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickflow.llm import language_id
from tickflow.llm.language_id import forward_backward


@pytest.mark.parametrize("counts", [[3], [1, 4, 2, 1], [0, 3, 0, 2, 0], [5, 1]])
def test_forward_backward_equals_the_sum_over_all_paths(counts):
    rng = np.random.default_rng(sum(counts))
    n, total = 3, sum(counts)
    scores, change, first = rng.normal(0, 2, (total, n)), rng.normal(0, 1, (n, n)), rng.normal(0, 1, n)
    shares, pairs = forward_backward(scores, np.array(counts), change, first, with_pairs=True)
    want, want_pairs, at = np.zeros((total, n)), np.zeros((n, n)), 0
    for c in counts:
        weights = {}
        for path in itertools.product(range(n), repeat=c):
            z = sum(scores[at + t, s] for t, s in enumerate(path)) + sum(change[a, b] for a, b in zip(path, path[1:]))
            weights[path] = np.exp(z + (first[path[0]] if c else 0))
        whole = sum(weights.values())
        for path, w in weights.items():
            for t, s in enumerate(path):
                want[at + t, s] += w / whole
            for a, b in zip(path, path[1:]):
                want_pairs[a, b] += w / whole
        at += c
    assert np.allclose(shares, want) and np.allclose(pairs, want_pairs)


def speaker(seed, syllables):
    rng = random.Random(seed)
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    return lambda n: " ".join(rng.choice(words) for _ in range(n))


ENGLISH = speaker(1, ["the", "ing", "wh", "or", "ed", "st", "an"])
FRENCH = speaker(2, ["le", "eau", "ou", "é", "que", "ment", "an"])


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(5)
    rows = [(i, (ENGLISH if i % 2 else FRENCH)(rng.randint(1, 200)), "en" if i % 2 else "fr") for i in range(400)]
    rows += [(1000, None, "en"), (1001, "", "fr"), (1002, "123", "en"), (None, "le le", "en"), (1003, "the ing", None),
             (7, rows[7][1], "en"), (7, rows[7][1], "en")]
    docs = spark.createDataFrame([(*r, "x", 1, "k") for r in rows],
                                 "doc_id long, text string, lang string, source string, key int, spans string").repartition(4)
    return docs, language_id.train(docs)


def test_held_out_documents(spark, model):
    docs, chain = model
    # what a held-out row says of its language plays no part
    assert chain.labels == ["en", "fr"]
    found = language_id.contract(language_id.label_words(docs, chain))
    rows = found.join(docs.select("doc_id", "lang").distinct(), "doc_id").where("held_out and doc_id < 400").collect()
    assert len(rows) > 90
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_code_switching(spark, model):
    _, chain = model
    parts = [("en", ENGLISH(40)), ("fr", FRENCH(30)), ("en", ENGLISH(25))]
    text = "... ".join(t for _, t in parts)
    row = language_id.label_words(spark.createDataFrame([(1, text)], "doc_id long, text string"), chain).first()
    assert row["n_words"] == 95 and row["lang_pred"] == "en"
    cover = {"en": 0, "fr": 0}
    for s in row["spans"]:
        piece = text[s["start"]:s["end"]]
        assert piece and piece == piece.strip()
        at = text.index(parts[1][1])
        inside = max(0, min(s["end"], at + len(parts[1][1])) - max(s["start"], at))
        cover["fr"] += inside if s["lang"] == "fr" else 0
        cover["en"] += len(piece) - inside if s["lang"] == "en" else 0
    assert cover["fr"] > 0.8 * len(parts[1][1]) and cover["en"] > 0.8 * (len(text) - len(parts[1][1]))


def test_unusual_texts(spark, model):
    _, chain = model
    long = ENGLISH(60_000)
    rows = [(1, None), (2, ""), (3, "12 -- 34"), (4, "“…” — 😀"), (5, long), (6, "日本"), (None, "the the ing"), (6, "日本")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = language_id.label_words(docs, chain).collect()
    by_id = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows)
    for k in (1, 2, 3, 4):
        assert (by_id[k]["lang_pred"], by_id[k]["score"], by_id[k]["n_words"], by_id[k]["spans"]) == ("und", 0.0, 0, [])
    assert by_id[5]["lang_pred"] == "en" and by_id[5]["n_words"] == 60_000
    assert by_id[5]["spans"][-1]["end"] == len(long)
    assert by_id[6]["lang_pred"] in ("en", "fr") and by_id[None]["lang_pred"] == "en"
    assert language_id.label_words(docs.limit(0), chain).collect() == []


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "the", None), (2, "x", None)], "doc_id long, text string, lang string")
    chain = language_id.train(docs)
    assert chain is None
    assert {r["lang_pred"] for r in language_id.label_words(docs, chain).collect()} == {"und"}
    assert language_id.train(docs.limit(0)) is None


def test_one_language(spark):
    docs = spark.createDataFrame([(i, "the of", "en") for i in range(6)], "doc_id long, text string, lang string")
    rows = language_id.label_words(docs, language_id.train(docs)).collect()
    assert all((r["lang_pred"], r["score"]) == ("en", 1.0) for r in rows)


def test_lexicon_counts_all_documents(spark):
    rows = [(i, "alpha beta", "en") for i in range(50)] + [(100 + i, "alpha gamma", "fr") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    table = language_id.lexicon(language_id._labelled(docs), ["en", "fr"])
    held = docs.where(~language_id.held_out(F.col("doc_id")))
    n = {r["lang"]: r["count"] for r in held.groupBy("lang").count().collect()}
    text = language_id.Text(pa.array(["beta"]))
    uses = np.array([n["en"], 0.0])
    total = np.array([2 * n["en"], 2 * n["fr"]])
    rate = np.log((uses + 0.5) / (total + 0.5 * language_id.LEXICON))
    want = (rate - rate.mean()) * (n["en"] / (n["en"] + 2))
    assert np.allclose(table[int(text.hash[0] % np.uint64(language_id.LEXICON))], np.clip(want, -4, 4), atol=1e-5)


def test_slices_of_a_batch_read_their_own_texts(model):
    _, chain = model
    texts = [ENGLISH(30), None, "--", FRENCH(25), ENGLISH(9), FRENCH(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    whole = language_id._labels(chain, batch).to_pylist()
    parts = [r for a, n in ((0, 1), (1, 3), (4, 2)) for r in language_id._labels(chain, batch.slice(a, n)).to_pylist()]
    assert [r["lang_pred"] for r in whole] == ["en", "und", "und", "fr", "en", "fr"]
    for a, b in zip(whole, parts):
        assert a["score"] == pytest.approx(b["score"], abs=1e-9) and a["spans"] == b["spans"]
