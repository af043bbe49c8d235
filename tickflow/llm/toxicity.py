"""Toxicity scores from a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.llm.words import ALNUM, LOWER, Words, byte_sums, mix, return_memory, slices, span_hash, string_buffer
from tickflow.runtime import written

SAMPLE_ROWS = 4_000       # labelled documents of each class that the model is fitted on, at most
BUCKETS = 1 << 16
DIM, FILTERS, WIDTHS = 16, 16, (1, 2, 3)
PREFIXES, SUFFIXES = (3, 4, 5, 6, 7), (3, 4)     # bytes
LANGUAGE_ROWS = 20        # calibration documents of either label from which a language gets its own threshold
LANGUAGES = 64            # languages with thresholds of their own, at most: those with the most labelled documents
THRESHOLD = 0.3
BINS = 100                # cells of the score histogram in one unit of log-odds
PIECE = 1 << 14           # places whose filter responses are held at once when texts are scored; a text is whole
SCHEMA = "doc_id long, lang string, score double"


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket numbers of each distinct word, the word of every position, and words per text.

    A word is known by itself and by how it begins and ends, so that unseen forms of a seen stem
    share its embeddings.
    """
    buf, bounds = string_buffer(column)
    buf = LOWER[buf]
    words = Words(buf, bounds, ALNUM)
    sums = byte_sums(buf)
    whole = span_hash(sums, words.starts, words.ends)
    _, first, position = np.unique(whole, return_index=True, return_inverse=True)
    a, b = words.starts[first], words.ends[first]
    parts = [whole[first]]
    for k, n in enumerate(PREFIXES):
        parts.append(mix(span_hash(sums, a, np.minimum(a + n, b)) + np.uint64(k + 1)))
    for k, n in enumerate(SUFFIXES):
        parts.append(mix(span_hash(sums, np.maximum(b - n, a), b) + np.uint64(100 + k)))
    return (np.stack(parts, 1) % np.uint64(BUCKETS)).astype(np.int32), position, words.counts


def _padded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where every word and every text begins once each text got max(WIDTHS) - 1 blank places behind it."""
    gap = max(WIDTHS) - 1
    starts = np.concatenate(([0], np.cumsum(counts + gap)[:-1])) if len(counts) else counts
    place = np.arange(counts.sum()) + np.repeat(np.arange(len(counts)) * gap, counts)
    return place, starts


class TextCNN:
    """Mean of hashed embeddings per word, filters of several widths, ReLU, max pooling, one output."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.taps = [(w, j) for w in WIDTHS for j in range(w)]
        self.kernel = rng.normal(0, 0.3, (DIM, len(self.taps) * FILTERS)).astype(np.float32)
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)
        self.scale, self.offset = 1.0, 0.0

    def pooled(self, vectors: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter responses at every place, and their maximum per text."""
        taps = vectors @ self.kernel
        n = len(vectors)
        response = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
        for k, (w, j) in enumerate(self.taps):
            own = response[:, WIDTHS.index(w) * FILTERS:(WIDTHS.index(w) + 1) * FILTERS]
            tap = taps[:, k * FILTERS:(k + 1) * FILTERS]
            if j == 0:
                own[:] = tap
            else:
                own[:n - j] += tap[j:]
        return response, np.maximum.reduceat(response, starts, axis=0)

    def vectors(self, buckets, position, counts):
        place, starts = _padded(counts)
        x = np.zeros((int(counts.sum()) + len(counts) * (max(WIDTHS) - 1), DIM), np.float32)
        table = self.embed[buckets].mean(axis=1)
        x[place] = table[position]
        return x, starts, place

    def logits(self, column: pa.Array) -> np.ndarray:
        if len(column) == 0:
            return np.empty(0)
        x, starts, _ = self.vectors(*features(column))
        first = np.unique(np.searchsorted(starts, np.arange(0, len(x), PIECE)))
        first = np.append(first[first < len(starts)], len(starts))
        ends, tops = np.append(starts, len(x)), []
        for a, b in zip(first, first[1:]):
            # the places behind a piece count as they do where all texts stand in one
            near = x[ends[a]:ends[b] + max(WIDTHS) - 1]
            tops.append(self.pooled(near, np.append(starts[a:b], ends[b] if ends[b] < len(x) else []).astype(np.int64) - ends[a])[1][:b - a])
        top = np.concatenate(tops)
        return np.maximum(top + self.bias, 0) @ self.out + self.shift[0]

    def score(self, column: pa.Array) -> np.ndarray:
        z = np.clip(self.scale * self.logits(column).astype(np.float64) + self.offset, -500, 500)
        return 1 / (1 + np.exp(-z))

    def start_from(self, weight: np.ndarray) -> None:
        """First embedding component: how much a bucket leans to label 1; first filters read it."""
        self.embed[:, 0] = weight
        for k in range(len(self.taps)):
            self.kernel[0, k * FILTERS:k * FILTERS + 4] = 1.0
        for w in range(len(WIDTHS)):
            self.out[w * FILTERS:w * FILTERS + 4] = 0.5

    def fit(self, texts: Sequence[str], labels: np.ndarray, epochs: int = 4, batch: int = 48,
            rate: float = 0.02, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        state: dict[str, np.ndarray] = {"embed": np.zeros(BUCKETS, np.float32)}
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), batch):
                rows = order[a:a + batch]
                self._step(pa.array([texts[r] for r in rows], pa.string()), labels[rows], rate, state)

    def _step(self, column, y, rate, state):
        buckets, position, counts = features(column)
        x, starts, place = self.vectors(buckets, position, counts)
        response, top = self.pooled(x, starts)
        hidden = np.maximum(top + self.bias, 0)
        z = np.clip(hidden @ self.out + self.shift[0], -30, 30)
        error = ((1 / (1 + np.exp(-z))) - y).astype(np.float32) / len(y)
        d_hidden = np.outer(error, self.out) * (hidden > 0)
        # The first place at which each text's maximum stands; only it receives the gradient.
        lengths = np.diff(np.append(starts, len(x)))
        same = response == np.repeat(top, lengths, axis=0)
        flat, which = np.nonzero(same.T)
        text_of = np.repeat(np.arange(len(starts)), lengths)[which]
        _, firsts = np.unique(flat * len(starts) + text_of, return_index=True)
        f, r, t = flat[firsts], which[firsts], text_of[firsts]
        g = d_hidden[t, f]
        d_kernel = np.zeros_like(self.kernel)
        d_x = np.zeros_like(x)
        for k, (w, j) in enumerate(self.taps):
            own = (f // FILTERS == WIDTHS.index(w)) & (r + j < len(x))
            column_of, row, gk = k * FILTERS + f[own] % FILTERS, r[own] + j, g[own]
            np.add.at(d_kernel.T, column_of, x[row] * gk[:, None])
            np.add.at(d_x, row, self.kernel.T[column_of] * gk[:, None])
        touched = np.flatnonzero(np.abs(d_x).sum(axis=1)[place])
        d_word = np.repeat(d_x[place[touched]] / buckets.shape[1], buckets.shape[1], axis=0)
        rows, inverse = np.unique(buckets[position[touched]].ravel(), return_inverse=True)
        d_embed = np.zeros((len(rows), DIM), np.float32)
        np.add.at(d_embed, inverse, d_word)
        state["embed"][rows] += (d_embed ** 2).mean(axis=1)
        self.embed[rows] -= rate * d_embed / np.sqrt(state["embed"][rows] + 1e-10)[:, None]
        for name, grad in (("kernel", d_kernel), ("bias", d_hidden.sum(axis=0)),
                           ("out", error @ hidden), ("shift", error.sum(keepdims=True))):
            total = state.setdefault(name, np.zeros_like(grad))
            total += grad ** 2
            value = getattr(self, name)
            value -= rate * grad / np.sqrt(total + 1e-10)


class Model:
    """A fitted classifier with its decision threshold for each language."""

    def __init__(self, net: TextCNN | None, prior: float, thresholds: dict[str, float], default: float):
        self.net, self.prior, self.thresholds, self.default = net, prior, thresholds, default

    def score(self, column: pa.Array) -> np.ndarray:
        return self.net.score(column) if self.net else np.full(len(column), self.prior)


def leanings(texts: Sequence[str], labels: np.ndarray) -> np.ndarray:
    """Log-odds of each bucket by the share of texts of either class that hold it, shrunk when rare."""
    seen = np.zeros((2, BUCKETS))
    for text, y in zip(texts, labels):
        buckets, _, _ = features(pa.array([text], pa.string()))
        seen[int(y), np.unique(buckets)] += 1
    share = (seen + 2) / (np.bincount(labels.astype(int), minlength=2)[:, None] + 4)
    return np.clip(np.log(share[1] / share[0]), -2, 4).astype(np.float32)


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """Middle of the gap below the cut with the best F1."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1                    # a cut never parts equal scores
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k])


def cut_of_histogram(bins: np.ndarray, hits: np.ndarray, misses: np.ndarray) -> float:
    """Score at the edge between bins of log-odds with the best F1; hits and misses are weights by bin."""
    order = np.argsort(-bins)
    z, hit = (bins[order] + 0.5) / BINS, np.cumsum(hits[order])
    f1 = 2 * hit / (np.cumsum(hits[order] + misses[order]) + hits.sum())
    k = int(np.argmax(f1))
    cut = (z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 0.5 / BINS
    return float(1 / (1 + np.exp(-cut)))


def held_side(labels: np.ndarray, seed: int = 3) -> np.ndarray:
    """Which rows the network is not fitted on: a fifth, or none where that leaves a side without both classes."""
    side = np.random.default_rng(seed).permutation(len(labels)) % 5 == 0
    if len(labels) < 50 or len(set(labels[side])) < 2 or len(set(labels[~side])) < 2:
        side[:] = False
    return side


def fit_model(rows: list, prevalence: float, seed: int = 3) -> Model:
    """Fit on four fifths of the rows (text, lang, label); calibrate scores and thresholds on the rest."""
    labels = np.array([r[2] for r in rows], np.float32)
    if len(rows) == 0 or labels.min() == labels.max():
        return Model(None, float(labels[0]) if len(rows) else 0.0, {}, THRESHOLD)
    texts = [r[0] or "" for r in rows]
    side = held_side(labels, seed)
    train = np.flatnonzero(~side)
    held = np.flatnonzero(side) if side.any() else train
    net = TextCNN()
    own = [texts[i] for i in train]
    net.start_from(leanings(own, labels[train]))
    net.fit(own, labels[train])
    z = np.concatenate([net.logits(pa.array([texts[i]], pa.string())) for i in held]).astype(np.float64)
    y = labels[held].astype(np.float64)
    net.scale, net.offset = platt(z, y)
    share = labels.mean()                            # the sample is not as the table is: move to its prior
    net.offset += np.log(prevalence / (1 - prevalence)) - np.log(share / (1 - share))
    scores = 1 / (1 + np.exp(-np.clip(net.scale * z + net.offset, -500, 500)))
    default = best_threshold(scores, y)
    thresholds = {}
    langs = np.array([str(rows[i][1]) for i in held])
    for lang in np.unique(langs):
        at = langs == lang
        if y[at].sum() >= LANGUAGE_ROWS and (1 - y[at]).sum() >= LANGUAGE_ROWS:
            thresholds[str(lang)] = best_threshold(scores[at], y[at])
    return Model(net, prevalence, thresholds, default)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make the scores probabilities, by damped Newton steps on smoothed labels."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        grad = np.array([((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum()])
        hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model of `train_scored`."""
    return train_scored(docs, labels, sample_rows)[0]


def train_scored(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Model, DataFrame | None]:
    """Fit on at most `sample_rows` labelled documents of each class; held-out ids give no labels.

    The rows are those with the smallest hash of their id; where rows repeat an id, the first text by its bytes
    stands for it. Then every document is scored once, into a written table (doc_id, lang, z) that comes back with
    the model, and its join with the labels gives the thresholds: from all labelled rows that the network was not
    fitted on. A language has a threshold of its own where LANGUAGE_ROWS such rows of either label exist, at most
    LANGUAGES have one; all others have the common one. Label rows without id or label are left out; of several
    labels of one document the larger counts. Without labels of both classes there is no table.
    """
    own = (labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).dropna()
           .where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1))
           .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    counts = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    rows = []
    for y in (0, 1):
        sample = own.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        found = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("t"))
        rows += found.select("t.text", "t.lang", "toxic", "doc_id").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    total = sum(counts.values())
    prevalence = min(max(counts.get(1, 0) / total, 1e-4), 1 - 1e-4) if total else 0.0
    model = fit_model(rows, prevalence)
    if model.net is None:
        return model, None
    scored = written(log_odds(docs, model), "toxicity-scores")
    side = held_side(np.array([r["toxic"] for r in rows]))
    if side.any():
        fitted = sorted({r["doc_id"] for r, held in zip(rows, side) if not held})
        set_thresholds(model, scored.join(own, "doc_id"), fitted)
    return model, scored


def log_odds(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, z: the log-odds of every row of documents, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=1_000_000):
            net = shared.value.net
            z = np.clip(net.scale * net.logits(batch.column("text")).astype(np.float64) + net.offset, -500, 500)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(z, pa.float64())],
                                             ["doc_id", "lang", "z"])
        return_memory()

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(
        place, "doc_id long, lang string, z double")


def set_thresholds(model: Model, labelled: DataFrame, fitted: list[int]) -> None:
    """Thresholds from all labelled rows (doc_id, lang, z, toxic) whose id the network was not fitted on.

    A histogram by language, label and log-odds comes to the driver. What was left out is made up for by weights,
    so each language has the class mix of the whole table.
    """
    spark = labelled.sparkSession
    ids = spark.createDataFrame([(i,) for i in fitted], "doc_id long")
    binned = written(labelled.join(F.broadcast(ids.withColumn("fit", F.lit(True))), "doc_id", "left").select(
        "lang", "toxic", F.floor(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("z"))) * BINS).cast("int").alias("bin"),
        F.col("fit").isNull().alias("free")).groupBy("lang", "toxic", "bin", "free").count(), "toxicity-bins")
    sizes = (binned.groupBy("lang").agg(*[F.sum(F.when(F.col("toxic") == y, F.col("count")).otherwise(0)).alias(f"n{y}") for y in (0, 1)],
                                        *[F.sum(F.when((F.col("toxic") == y) & F.col("free"), F.col("count")).otherwise(0)).alias(f"f{y}")
                                          for y in (0, 1)]))
    able = (sizes.where((F.col("lang").isNotNull()) & (F.least("f0", "f1") >= LANGUAGE_ROWS))
            .orderBy(F.desc(F.col("n0") + F.col("n1")), "lang").limit(LANGUAGES).collect())

    def cut(cells: list, total: list[int]) -> float | None:
        at = np.array(cells, np.int64).reshape(-1, 3)
        have = [int(at[at[:, 1] == y, 2].sum()) for y in (0, 1)]
        if min(have) == 0:
            return None
        bins, place_of = np.unique(at[:, 0], return_inverse=True)
        miss, hit = (np.bincount(place_of, at[:, 2] * (at[:, 1] == y), minlength=len(bins)) * total[y] / have[y]
                     for y in (0, 1))
        return cut_of_histogram(bins, hit, miss)

    free = binned.where("free")
    cells = [(r["bin"], r["toxic"], r["n"]) for r in free.groupBy("bin", "toxic").agg(F.sum("count").alias("n")).collect()]
    whole = sizes.agg(F.sum("n0"), F.sum("n1")).first()
    common = cut(cells, [whole[0] or 0, whole[1] or 0])
    if common is None:
        return
    model.default, model.thresholds = common, {}
    by_lang: dict = {}
    for r in free.where(F.col("lang").isin([r["lang"] for r in able])).collect():
        by_lang.setdefault(r["lang"], []).append((r["bin"], r["toxic"], r["count"]))
    for r in able:
        model.thresholds[r["lang"]] = cut(by_lang[r["lang"]], [r["n0"], r["n1"]])


def judged(scored: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and whether it reaches its language's threshold, from a table of log-odds."""
    score = 1 / (1 + F.exp(-F.col("z")))
    return scored.withColumn("score", score).select("doc_id", "score", (F.col("score") >= threshold(model)).alias("rejected"))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Per document row: doc_id, score, and whether the score reaches its language's threshold.

    Whole texts are scored. NULL and empty texts get the score of a text without words; a NULL or unknown
    language has the common threshold; a NULL doc_id stays NULL; repeated rows each give a row; other
    columns are ignored. Without labels of both classes every score is the share of label 1.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=1_000_000):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"),
                 pa.array(shared.value.score(batch.column("text")), pa.float64())], ["doc_id", "lang", "score"])
        return_memory()

    scored = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")) \
        .mapInArrow(score, SCHEMA)
    return scored.select("doc_id", "score", (F.col("score") >= threshold(model)).alias("rejected"))


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of the documents whose score stays below the threshold of their language, in one pass.

    Rows are judged one by one, also without a doc_id or repeated; a NULL or empty text is judged as a text
    without words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keeper(shared), docs.schema)


def _keeper(shared):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=1_000_000):
            own = shared.value
            limit = np.array([own.thresholds.get(x, own.default) for x in batch.column("lang").to_pylist()])
            yield batch.filter(pa.array(own.score(batch.column("text")) < limit))
        return_memory()

    return keep


def threshold(model: Model) -> F.Column:
    limit = F.lit(model.default)
    for lang, value in sorted(model.thresholds.items()):
        limit = F.when(F.col("lang") == lang, F.lit(value)).otherwise(limit)
    return limit


def contract(scored: DataFrame) -> DataFrame:
    """The columns of `op8_toxicity`."""
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "rejected")
