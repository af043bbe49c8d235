import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickflow.llm import pii, toxicity

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute(text):
    """The base spans by the patterns themselves."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                    "card": lambda: 16 <= len(digits) <= 19 and pii.luhn(digits),
                    "phone": lambda: 8 <= len(digits) <= 15}[kind]()
            if good:
                out.append((kind, *m.span()))
    return out


def base(text):
    return [s for s in pii.find(text) if s[0] in pii.BASE_KINDS]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123456789.+- ()@ab%éA_", max_size=60))
def test_anchored_spans_equal_the_patterns(text):
    assert base(text) == brute(text)


@pytest.mark.parametrize("text", [
    "a@b.c@d.e x@@y.z", "1.2.3.4.5.6.7.8", "001.2.3.0255", "256.1.1.1.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111-",
    "4387513035237269 4387513035237269", "+1 (319) 555-5132.", "+12", "+1 2", "+1--2345678", "é" * 30 + "x.y@z.co", "",
    "+" * 20, "@" * 20, "a" * 1000 + "@" + "b" * 1000])
def test_cases(text):
    assert base(text) == brute(text)


def test_further_kinds():
    text = "see https://example.com/a?b=1. IBAN: GB82 WEST 1234 5698 7654 32 iban GB82WEST12345698765433 ssn 123-45-6789"
    found = [(k, text[a:b]) for k, a, b in pii.find(text) if k not in pii.BASE_KINDS]
    assert found == [("url", "https://example.com/a?b=1"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("ssn", "123-45-6789")]


def test_query_columns(spark, documents):
    rows = [(1, "x hsr.29@mail5.example.com y 10.0.0.1"), (None, None), (2, ""), (2, ""), (3, "é +1 (319) 555-5132")]
    got = sorted(pii.contract(pii.personal_data(documents(rows))).collect(), key=str)
    assert len(got) == 5
    for r in got:
        text = next(t or "" for i, t in rows if i == r["doc_id"])
        own = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(text))
        assert r["base_sha256"] == hashlib.sha256(own.encode()).hexdigest()
        assert r["spans"] == own and r["n_email"] + r["n_ip"] + r["n_phone"] == len(brute(text))
    assert pii.contract(pii.personal_data(documents([]))).count() == 0


def labelled(spark, documents, n=400):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    rows, labels = [], []
    for k in range(n):
        text = [words[j] for j in rng.integers(0, 300, 40)]
        if k % 4 == 0:
            for _ in range(3):
                text.insert(int(rng.integers(0, 40)), "vile" + "".join(rng.choice(list("xyz"), 3)))
        rows.append((k, " ".join(text)))
        labels.append((k, int(k % 4 == 0), 0.0))
    return rows, spark.createDataFrame(labels, "doc_id long, toxic int, lang double")


def test_toxicity_on_held_out_rows(spark, documents):
    rows, labels = labelled(spark, documents)
    docs = documents(rows + [(900, None), (901, ""), (None, "vilexyz"), (900, None)])
    model = toxicity.train(docs, labels)
    got = toxicity.contract(toxicity.toxicity(docs, model)).collect()
    assert len(got) == len(rows) + 4
    for r in got:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.95
    kept = toxicity.kept(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {900, 901}
    assert kept.where("doc_id % 4 = 0 and doc_id < 400").count() <= 5


def test_toxicity_without_labels(spark, documents):
    rows, labels = labelled(spark, documents, 8)
    docs = documents(rows)
    for some in (labels.limit(0), labels.where("toxic = 1"), labels.selectExpr("doc_id", "cast(null as int) toxic")):
        model = toxicity.train(docs, some)
        assert {r["score"] for r in toxicity.toxicity(docs, model).collect()} in ({0.0}, {1.0})
    assert toxicity.toxicity(documents([]), model).count() == 0


def test_thresholds_come_from_all_labelled_rows(spark, documents):
    """Two languages of 75 toxic rows each among 1,500: a sample of 150 of each class holds too few, the table has enough."""
    from pyspark.sql import functions as F
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(1500):
        toxic = k % 10 == 0
        rows.append((k, " ".join(rng.choice(words, 20)) + (" vile" if toxic and k % 30 else " vile fair" if k % 17 == 0 else "")))
        labels.append((k, int(toxic)))
    docs = documents(rows).withColumn("lang", F.when(F.col("doc_id") % 20 < 10, "en").otherwise("fr"))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    sample = toxicity.train(docs, marks, sample_rows=60)
    assert set(sample.thresholds) == {"en", "fr"}

    own = marks.where(~toxicity.held_out(F.col("doc_id")))
    got = toxicity.toxicity(docs, sample).join(own, "doc_id").toPandas()
    f1 = lambda p: 2 * (p & (got.toxic == 1)).sum() / (p.sum() + (got.toxic == 1).sum())
    best = max(f1(got.score >= c) for c in np.unique(got.score))
    assert f1(got.rejected) > best - 0.08


def test_a_scoring_task_needs_little_memory():
    """Two megabytes of text in one batch: what a task takes besides its input stays below 80 MB, and every row is judged."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa
    rng = np.random.default_rng(1)
    words = np.array([f"w{k:04d}" for k in range(3000)])
    texts = [" ".join(rng.choice(words, 400)) for _ in range(840)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()),
                                        pa.array(["en", None] * (len(texts) // 2), pa.string())], ["doc_id", "text", "lang"])
    model = toxicity.Model(toxicity.TextCNN(), 0.1, {}, 0.5)
    limit = float(np.median(model.score(batch.column("text").slice(0, 100))))
    model.default = limit
    keep = toxicity._keeper(SimpleNamespace(value=model))
    next(keep(iter([batch.slice(0, 5)])), None)
    tracemalloc.start()
    kept = [i for part in keep(iter([batch])) for i in part.column("doc_id").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20 and 0 < len(kept) < len(texts)
    # responses by pieces are those of all places at once
    column = pa.array([*texts[:60], "", None, *texts[60:130]], pa.string())
    net = model.net
    x, starts, _ = net.vectors(*toxicity.features(column))
    whole = np.maximum(net.pooled(x, starts)[1] + net.bias, 0) @ net.out + net.shift[0]
    assert len(x) > 2 * toxicity.PIECE and np.allclose(net.logits(column), whole, rtol=0, atol=1e-5)
