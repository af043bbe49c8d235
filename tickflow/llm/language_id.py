"""Language of the words and texts of a corpus by a linear-chain conditional random field, trained in numpy.

Each word is a state of the chain and each language a label. A word speaks for a language by hashed features
(itself, how it begins and ends, the character runs inside) and by a lexicon of how often each language uses
it; learned transitions tell how readily the language changes from one word to the next. Forward-backward
sums give every word's share of each language, and a text has the language with the largest share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickflow.llm.words import (LOWER, Words, byte_sums, byte_table, mix, return_memory, slices, span_hash,
                                string_buffer)

LABELS = 64               # languages of a model, at most: those with the most documents
SAMPLE_DOCS = 240         # labelled documents of each language that the chain is fitted on, at most
SPANS, SPAN_WORDS = 4, 40  # stretches taken from all over each of them, and their words
LEXICON = 1 << 17         # hashed words whose uses are counted by language, over all labelled documents
BLOCK = 1 << 12
BUCKETS = 1 << 16
AFFIXES = (1, 2, 3, 4)    # bytes
GRAMS = (2, 3)
SLICE = 8_000_000

# ASCII letters and everything beyond ASCII; a text without any letter of any script has no words
LETTER = byte_table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
SPANS_TYPE = "array<struct<start:long,end:long,lang:string>>"
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


class Text:
    """Words of a batch: distinct ones with their features, and the distinct word at every place."""

    def __init__(self, column: pa.Array):
        self.raw, bounds = string_buffer(column)
        buf = LOWER[self.raw]
        self.words = Words(buf, bounds, LETTER)
        sums = byte_sums(buf)
        whole = span_hash(sums, self.words.starts, self.words.ends)
        self.hash, first, self.position = np.unique(whole, return_index=True, return_inverse=True)
        self._sums, self._a, self._b = sums, self.words.starts[first], self.words.ends[first]

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all features of the distinct words, and where those of each word begin."""
        a, b, sums = self._a, self._b, self._sums
        n = len(a)
        fixed = [self.hash]
        for k in AFFIXES:
            fixed.append(mix(span_hash(sums, a, np.minimum(a + k, b)) + np.uint64(k)))
            fixed.append(mix(span_hash(sums, np.maximum(b - k, a), b) + np.uint64(100 + k)))
        counts = [np.maximum(b - a - k + 1, 0) for k in GRAMS]
        size = len(fixed) + sum(counts)
        starts = np.concatenate(([0], np.cumsum(size)))
        out = np.empty(int(starts[-1]), np.uint64)
        for j, column in enumerate(fixed):
            out[starts[:-1] + j] = column
        at = starts[:-1] + len(fixed)
        for k, count in zip(GRAMS, counts):
            within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            place = np.repeat(a, count) + within
            out[np.repeat(at, count) + within] = mix(span_hash(sums, place, place + k) + np.uint64(200 + k))
            at = at + count
        return (out % np.uint64(BUCKETS)).astype(np.int32), starts[:n + 1]


class Chain:
    """Weights of the field over `labels`; `lexicon` holds one row of scores for each hashed word."""

    def __init__(self, labels: list[str], lexicon: np.ndarray):
        n = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.weight = np.zeros((BUCKETS, n), np.float32)
        self.trust = np.full(n, 0.5, np.float32)      # of the lexicon, by language
        self.change = np.eye(n, dtype=np.float32)
        self.first = np.zeros(n, np.float32)

    def lexical(self, text: Text) -> np.ndarray:
        return self.lexicon[(text.hash % np.uint64(LEXICON)).astype(np.int64)]

    def emissions(self, text: Text) -> np.ndarray:
        """Score of each language for each distinct word."""
        if not len(text.hash):
            return np.zeros((0, len(self.labels)))
        out = self.lexical(text) * self.trust
        buckets, starts = text.features()
        step = 200_000                                # words at a time
        for a in range(0, len(text.hash), step):
            b = min(a + step, len(text.hash))
            own = self.weight[buckets[starts[a]:starts[b]]]
            sizes = np.diff(starts[a:b + 1])[:, None]
            out[a:b] += np.add.reduceat(own, starts[a:b] - starts[a], axis=0) / np.sqrt(sizes)
        return out.astype(np.float64)

    def shares(self, text: Text) -> np.ndarray:
        """Posterior share of each language for each word of the batch."""
        return forward_backward(self.emissions(text)[text.position], text.words.counts, self.change, self.first)[0]

    def fit(self, sequences: list[tuple[pa.Array, np.ndarray]], rate: float = 0.2, epochs: int = 3) -> None:
        """Maximum likelihood by adaptive gradient steps, one for each batch (texts, label of every word)."""
        state = {k: np.zeros_like(getattr(self, k)) for k in ("weight", "trust", "change", "first")}

        def step(name, rows, grad):
            total, value = state[name], getattr(self, name)
            total[rows] += grad ** 2
            value[rows] -= rate * grad / np.sqrt(total[rows] + 1e-8)

        for _ in range(epochs):
            for column, labels in sequences:
                text = Text(column)
                shares, pairs = forward_backward(self.emissions(text)[text.position], text.words.counts, self.change,
                                                 self.first, with_pairs=True)
                error = shares.copy()
                error[np.arange(len(labels)), labels] -= 1
                heads = text.words.bounds[:-1][text.words.counts > 0]
                inner = np.ones(len(labels), bool)
                inner[heads] = False
                at = np.flatnonzero(inner)
                seen = np.zeros_like(pairs)
                np.add.at(seen, (labels[at - 1], labels[at]), 1)
                scale = 1 / max(len(heads), 1)
                word = np.zeros((len(text.hash), len(self.labels)))
                np.add.at(word, text.position, error * scale)
                buckets, starts = text.features()
                sizes = np.diff(starts)
                rows, inverse = np.unique(buckets, return_inverse=True)
                grad = np.zeros((len(rows), len(self.labels)))
                np.add.at(grad, inverse, np.repeat(word / np.sqrt(sizes)[:, None], sizes, axis=0))
                step("trust", slice(None), (word * self.lexical(text)).sum(axis=0).astype(np.float32))
                step("weight", rows, grad.astype(np.float32))
                step("change", slice(None), ((pairs - seen) * scale).astype(np.float32))
                step("first", slice(None), (error[heads].sum(axis=0) * scale).astype(np.float32))


def forward_backward(scores: np.ndarray, counts: np.ndarray, change: np.ndarray, first: np.ndarray,
                     with_pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Posterior shares of the labels at each place of several chains, one after the other, and the expected
    number of each change. All chains take a step together; the sums are scaled at every step."""
    n = scores.shape[1]
    local = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    move = np.exp(change.astype(np.float64) - change.max())
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    begin = (np.cumsum(counts) - counts)[order]
    lengths = counts[order]
    longest = int(lengths[0]) if len(lengths) else 0
    # chains still under way at each step
    active = np.searchsorted(-lengths, -np.arange(longest), "left") if longest else np.empty(0, int)
    forward, backward = np.empty_like(local), np.empty_like(local)
    pairs = np.zeros((n, n))
    now = np.exp(first.astype(np.float64) - first.max())[None, :]
    for t in range(longest):
        k = active[t]
        at = begin[:k] + t
        now = local[at] * (now if t == 0 else now[:k] @ move)
        now /= now.sum(axis=1, keepdims=True)
        forward[at] = now
    later = np.ones((len(lengths), n))
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        backward[at] = later[:k]
        if t:
            weighed = local[at] * later[:k]
            if with_pairs:
                both = forward[at - 1][:, :, None] * move * weighed[:, None, :]
                pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back = weighed @ move.T
            later[:k] = back / back.sum(axis=1, keepdims=True)
    shares = forward * backward
    if len(shares):
        shares /= shares.sum(axis=1, keepdims=True)
    return shares, pairs


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _labelled(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang of the rows that may be learned from."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    return own.where("doc_id is not null and text is not null and lang is not null").where(~held_out(F.col("doc_id")))


def lexicon(labelled: DataFrame, labels: list[str]) -> np.ndarray:
    """How much each hashed word leans to each language, from its uses in all labelled documents.

    Tasks count in a table of fixed size; only the sums come to the driver.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(labels), LEXICON), np.int64)
        for batch in slices(batches):
            text = Text(batch.column("text"))
            code = pc.index_in(batch.column("lang"), pa.array(labels, pa.string())).to_numpy(zero_copy_only=False)
            cell = (text.hash % np.uint64(LEXICON)).astype(np.int64)[text.position]
            cell += code.astype(np.int64)[text.words.document()] * LEXICON
            total += np.bincount(cell, minlength=total.size).reshape(total.shape)
        parts = total.reshape(-1, BLOCK)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)),
                                          pa.array([parts[u].astype("<i4" if parts[u].max() < 2**31 else "<i8").tobytes()
                                                    for u in used], pa.binary())], ["block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for part in table.column("counts"):
            raw = part.as_py()
            total += np.frombuffer(raw, "<i4" if len(raw) == BLOCK * 4 else "<i8")
        return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    schema = "block int, counts binary"
    rows = (labelled.where(F.col("lang").isin(labels)).select("lang", "text").mapInArrow(count, schema)
            .groupBy("block").applyInArrow(add, schema).collect())
    total = np.zeros((len(labels) * LEXICON // BLOCK, BLOCK), np.int64)
    for r in rows:
        total[r["block"]] = np.frombuffer(r["counts"], "<i8")
    uses = total.reshape(len(labels), LEXICON).T.astype(np.float64)
    rates = np.log((uses + 0.5) / (uses.sum(axis=0) + 0.5 * LEXICON))
    rates -= rates.mean(axis=1, keepdims=True)
    # a word that was seen a few times only says little
    seen = uses.sum(axis=1, keepdims=True)
    return np.clip(rates * (seen / (seen + 2)), -4, 4).astype(np.float32)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to SPANS stretches of SPAN_WORDS words, evenly spread over each text."""
    for batch in slices(batches):
        text = Text(batch.column("text"))
        rows = []
        for d, (lang, key) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("key").to_pylist())):
            a, n = int(text.words.bounds[d]), int(text.words.counts[d])
            for s in range(min(SPANS, -(-n // SPAN_WORDS))):
                begin = a + (max(n - SPAN_WORDS, 0) * s) // max(SPANS - 1, 1)
                end = min(begin + SPAN_WORDS, a + n) - 1
                words = [text.raw[text.words.starts[k]:text.words.ends[k]].tobytes() for k in range(begin, end + 1)]
                rows.append((lang, key, s, b" ".join(words).decode("utf-8", "replace")))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.string())],
            ["lang", "key", "part", "text"])


def sequences(stretches: list, labels: list[str], batch: int = 32, seed: int = 7) -> list[tuple[pa.Array, np.ndarray]]:
    """Batches of code-switched texts put together from stretches (lang, text), with the label of each word.

    Every stretch opens one sequence; up to two more pieces of random languages and lengths follow.
    """
    rng = np.random.default_rng(seed)
    code = {lang: k for k, lang in enumerate(labels)}
    by_label = [[t.split(" ") for lang, t in stretches if code[lang] == k and t] for k in range(len(labels))]
    able = [k for k, own in enumerate(by_label) if own]
    made = []
    for k in able:
        for words in by_label[k]:
            parts = [(k, words)]
            for _ in range(int(rng.integers(0, 3))):
                other = int(rng.choice(able))
                taken = by_label[other][int(rng.integers(len(by_label[other])))]
                parts.append((other, taken[:int(rng.integers(3, SPAN_WORDS + 1))]))
            made.append((" ".join(w for _, ws in parts for w in ws), [c for c, ws in parts for _ in ws]))
    out = []
    order = rng.permutation(len(made))
    for a in range(0, len(order), batch):
        rows = [made[i] for i in order[a:a + batch]]
        out.append((pa.array([r[0] for r in rows], pa.string()), np.array([y for r in rows for y in r[1]], np.int64)))
    return out


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Chain | None:
    """A chain over the languages of the rows that are not held out, or None without any.

    The lexicon covers all of those rows. The weights come from stretches of at most `sample_docs` texts of
    each language, those with the smallest hashes of their ids; what reaches the driver is bounded by labels,
    texts and words of a stretch. At most LABELS languages are learned, those with the most documents.
    """
    labelled = _labelled(docs)
    top = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LABELS).collect()
    labels = sorted(r["lang"] for r in top)
    if not labels:
        return None
    keyed = labelled.where(F.col("lang").isin(labels)).withColumn("key", F.xxhash64("doc_id", "text"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("key"))
    chosen = keyed.select("lang", "key").withColumn("rank", rank).where(F.col("rank") <= sample_docs).select(
        "lang", "key").distinct()
    # at most LABELS * sample_docs rows
    stretches = (keyed.join(F.broadcast(chosen), ["lang", "key"]).select("lang", "key", "text")
                 .mapInArrow(_stretches, "lang string, key long, part int, text string")
                 .groupBy("lang", "key", "part").agg(F.min("text").alias("text")).collect())
    rows = sorted((r["lang"], r["key"], r["part"], r["text"]) for r in stretches)
    chain = Chain(labels, lexicon(labelled, labels))
    if len(labels) > 1:
        chain.fit(sequences([(r[0], r[3]) for r in rows], labels))
    return chain


def label_words(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """Per row: doc_id, lang_pred, score, n_words, and spans of words in one language (code points, end exclusive).

    Whole texts are read. `lang_pred` has the largest share of the text's words and `score` is that share.
    Texts that are NULL or without any letter are ``und`` with score 0 and no spans, as are all texts when
    nothing was learned. Rows are judged one by one, also without a doc_id or repeated; other columns are
    ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    schema = f"doc_id long, lang_pred string, score double, n_words long, spans {SPANS_TYPE}"

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE):
            yield _labels(shared.value, batch)
        return_memory()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(label, schema)


def _labels(chain: Chain | None, batch: pa.RecordBatch) -> pa.RecordBatch:
    column = batch.column("text")
    lettered = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False)
    # taken by number: a choice between a slice of texts and NULL reads past its buffer
    text = Text(column.take(pc.if_else(lettered, pa.array(np.arange(len(column))), pa.scalar(None, pa.int64()))))
    n = batch.num_rows
    lang, score = np.full(n, "und", object), np.zeros(n)
    offsets, parts = np.zeros(n + 1, np.int32), (np.empty(0, int),) * 3
    counts = text.words.counts
    filled = np.flatnonzero(counts)
    if chain is not None and len(filled):
        shares = chain.shares(text)
        total = np.add.reduceat(shares, text.words.bounds[filled], axis=0) / counts[filled][:, None]
        best = total.argmax(axis=1)
        lang[filled] = np.array(chain.labels, object)[best]
        score[filled] = np.minimum(total[np.arange(len(best)), best], 1.0)
        own = shares.argmax(axis=1)
        cut = np.ones(len(own), bool)
        cut[1:] = own[1:] != own[:-1]
        cut[text.words.bounds[filled]] = True
        head = np.flatnonzero(cut)
        tail = np.append(head[1:], len(own)) - 1
        point = np.concatenate(([0], np.cumsum((text.raw & 0xC0) != 0x80)))
        row = text.words.document()[head]
        begin = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n))))
        base = point[_row_starts(column, lettered)][row]
        parts = point[text.words.starts[head]] - base, point[text.words.ends[tail]] - base, own[head]
        offsets = begin.astype(np.int32)
    names = pa.array(chain.labels if chain is not None else [], pa.string())
    structs = pa.StructArray.from_arrays(
        [pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.int64()),
         names.take(pa.array(parts[2], pa.int64())) if len(names) else pa.array([], pa.string())],
        fields=list(_SPANS_ARROW.value_type))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
         pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)],
        ["doc_id", "lang_pred", "score", "n_words", "spans"])


def _row_starts(column: pa.Array, lettered: pa.Array) -> np.ndarray:
    """Byte at which each row begins in the buffer of the lettered texts."""
    sizes = pc.fill_null(pc.if_else(lettered, pc.binary_length(column), 0), 0).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.cumsum(sizes)))[:-1].astype(np.int64)


def contract(labelled: DataFrame) -> DataFrame:
    """The columns of `op13_language_id`."""
    return labelled.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
