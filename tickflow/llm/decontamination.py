"""Benchmark decontamination by winnowed fingerprints that are extended to whole shared spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.llm.words import ALNUM, LOWER, Words, covered, run_bounds, run_hash, slices, string_buffer, within
from tickflow.runtime import written

WINDOW = 10          # words: every shared span of this length is found
GRAM = 5             # words hashed into one fingerprint
PART_BYTES = 32_000_000   # benchmark text that is sent to the executors at once; more goes in further passes

SCHEMA = "doc_id long, text string, n_words long, spans array<int>, items array<string>"


def text_words(column: pa.Array) -> Words:
    buf, bounds = string_buffer(column)
    return Words(LOWER[buf], bounds, ALNUM)


def winnow(grams: np.ndarray, usable: np.ndarray, width: int) -> np.ndarray:
    """Positions of the smallest fingerprint (the rightmost among equals) of each window of `width` grams.

    A window that leaves its text holds an unusable gram and selects nothing.
    """
    n = len(grams) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    whole = np.lib.stride_tricks.sliding_window_view(usable, width).all(axis=1) if width > 1 else usable
    best, at = grams[:n].copy(), np.zeros(n, np.int8)
    for k in range(1, width):
        smaller = grams[k:k + n] <= best
        best[smaller] = grams[k:k + n][smaller]
        at[smaller] = k
    chosen = np.zeros(len(grams), bool)
    chosen[(np.arange(n) + at)[whole]] = True
    return np.flatnonzero(chosen)


class Benchmark:
    """One bounded part of the benchmark: word hashes, winnowed fingerprints and short items."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW, gram: int = GRAM):
        words = text_words(pa.array(texts, pa.string()))
        self.window, self.gram, self.ids = window, gram, np.array(ids, object)
        self.words, self.item = words.hashes(), words.document()
        grams = run_hash(self.words, gram)
        usable = within(words.counts, gram)[:len(grams)]
        at = winnow(grams, usable, window - gram + 1)
        order = np.argsort(grams[at], kind="stable")
        self.marks, self.places = grams[at][order], at[order]
        # An item of fewer words is one window of its own length.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, window):
            items = np.flatnonzero(words.counts == n)
            if len(items):
                own = run_hash(self.words, n)[words.bounds[items]]
                order = np.argsort(own, kind="stable")
                self.short[n] = own[order], items[order]

    def hits(self, words: np.ndarray, counts: np.ndarray, document: np.ndarray):
        """(start, length, item) of every window that occurs in the documents."""
        found = [self._extended(words, counts, document)]
        for n, (keys, items) in self.short.items():
            grams = run_hash(words, n)
            left, right = np.searchsorted(keys, grams), np.searchsorted(keys, grams, "right")
            at = np.flatnonzero((right > left) & within(counts, n)[:len(grams)])
            where, which = expand(at, left[at], right[at])
            found.append((where, np.full(len(where), n), items[which]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _extended(self, words, counts, document):
        gram, window = self.gram, self.window
        grams = run_hash(words, gram)
        at = winnow(grams, within(counts, gram)[:len(grams)], window - gram + 1)
        left = np.searchsorted(self.marks, grams[at])
        right = np.searchsorted(self.marks, grams[at], "right")
        seed = np.flatnonzero(right > left)
        here, which = expand(at[seed], left[seed], right[seed])
        there = self.places[which]
        starts, items = [], []
        for a in range(0, len(here), 200_000):       # bounded work space per step
            i, j = here[a:a + 200_000], there[a:a + 200_000]
            reach = np.arange(gram - window, window)
            p, q = i[:, None] + reach, j[:, None] + reach
            ok = (p >= 0) & (p < len(words)) & (q >= 0) & (q < len(self.words))
            p, q = np.clip(p, 0, len(words) - 1), np.clip(q, 0, len(self.words) - 1)
            ok &= (words[p] == self.words[q]) & (document[p] == document[i][:, None])
            ok &= self.item[q] == self.item[j][:, None]
            for k in range(window - gram + 1):
                row = np.flatnonzero(ok[:, k:k + window].all(axis=1))
                starts.append(i[row] + reach[k])
                items.append(self.item[j[row]])
        if not starts:
            return (np.empty(0, np.int64),) * 3
        starts, items = np.concatenate(starts), np.concatenate(items)
        return starts, np.full(len(starts), window), items


def expand(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row for each index in left..right of each place."""
    n = right - left
    first = np.repeat(left - np.concatenate(([0], np.cumsum(n)[:-1])), n) if len(n) else n
    return np.repeat(at, n), first + np.arange(n.sum())


def _matcher(part: Broadcast, keep_text: bool):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = part.value
        for batch in slices(batches):
            words = text_words(batch.column("text"))
            document = words.document()
            start, length, item = bench.hits(words.hashes(), words.counts, document)
            hit = np.zeros(len(document), bool)
            for size in np.unique(length):
                hit |= covered(start[length == size], int(size), len(hit))
            earlier = batch.column("spans").to_pylist()      # what the parts before this one have found
            items = [set(x) for x in batch.column("items").to_pylist()]
            for d, spans in enumerate(earlier):
                for a, b in zip(spans[::2], spans[1::2]):
                    hit[words.bounds[d] + a:words.bounds[d] + b] = True
            runs = [[] for _ in range(batch.num_rows)]
            for a, b in zip(*run_bounds(hit, words.bounds)):
                d = document[a]
                runs[d] += [int(a - words.bounds[d]), int(b - words.bounds[d])]
            pair = np.unique(document[start] * len(bench.ids) + item)
            for d, k in zip(pair // max(1, len(bench.ids)), bench.ids[pair % max(1, len(bench.ids))]):
                items[d].add(k)
            text = batch.column("text") if keep_text else pa.nulls(batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), text, pa.array(words.counts, pa.int64()),
                 pa.array(runs, pa.list_(pa.int32())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                ["doc_id", "text", "n_words", "spans", "items"])
    return match


def _parts(benchmark: DataFrame, part_bytes: int) -> Iterator[list]:
    """The benchmark's items in parts of bounded size, streamed to the driver one after another."""
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")) \
        .where("item_id is not null")
    part, size = [], 0
    for row in rows.toLocalIterator():
        part.append(row)
        size += len(row["text"] or "") * 2 + 64
        if size >= part_bytes:
            yield part
            part, size = [], 0
    if part:
        yield part


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM,
                  part_bytes: int = PART_BYTES) -> DataFrame:
    """Per document row: word count, the word runs that lie in benchmark windows, and the items they come from.

    Fingerprints of `gram` words are kept where they are the smallest of `window - gram + 1`
    neighbours, on both sides; two texts that share `window` words share one such fingerprint. Seeds
    are extended word by word, so only true windows count. Words are ASCII letters (lower-cased),
    digits and everything beyond ASCII. The benchmark goes to the executors in parts of at most
    `part_bytes`; each further part is one more pass over the documents that adds to what was found.

    Returns doc_id, n_words, spans (flat start, end pairs in words, end exclusive) and items (sorted as
    strings). NULL or empty texts have no words and no hits; rows with a NULL doc_id or with a repeated
    doc_id each get their own row; items without words or id match nothing; repeated items each count by
    their id; other columns are ignored.
    """
    spark = docs.sparkSession
    none = "cast(array() as array<int>) as spans", "cast(array() as array<string>) as items"
    found = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text", *none)
    parts = _parts(benchmark, part_bytes)
    part, first = next(parts, []), True
    while first or part:
        following = next(parts, None)
        if not first:
            found = written(found.drop("n_words"), "decontamination")
        bench = spark.sparkContext.broadcast(Benchmark([r[0] for r in part], [r[1] for r in part], window, gram))
        found = found.mapInArrow(_matcher(bench, following is not None), SCHEMA)
        part, first = following, False
    return found.drop("text")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM,
          part_bytes: int = PART_BYTES) -> DataFrame:
    """All columns of the documents that hold no benchmark window; one pass per part of the benchmark.

    Rows are judged one by one, also without a doc_id or repeated; NULL and empty texts are clean.
    """
    def keeper(part: Broadcast):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                words = text_words(batch.column("text"))
                document = words.document()
                start, _, _ = part.value.hits(words.hashes(), words.counts, document)
                good = np.ones(batch.num_rows, bool)
                good[document[start]] = False
                yield batch.filter(pa.array(good))
        return keep

    context, first = docs.sparkSession.sparkContext, True
    for part in _parts(benchmark, part_bytes):
        if not first:
            docs = written(docs, "decontamination")
        bench = context.broadcast(Benchmark([r[0] for r in part], [r[1] for r in part], window, gram))
        docs, first = docs.mapInArrow(keeper(bench), docs.schema), False
    return docs


def contract(found: DataFrame) -> DataFrame:
    """The digest columns of `op10_decontamination`."""
    hit = F.aggregate(F.col("spans"), F.lit(0), lambda total, bound: bound - total)   # end - start + ...
    return found.select(
        "doc_id", "n_words",
        hit.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))

