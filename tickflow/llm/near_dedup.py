"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded and verified."""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickflow.llm.exchange import pack, unpack
from tickflow.llm.links import components
from tickflow.llm.words import ALNUM, LOWER, Words, mix, run_hash, running, slices, span_hash, string_buffer, within
from tickflow.runtime import attach, written

SHINGLE = 5               # words
SIMILARITY = 0.8
BANDS, ROWS = 12, 3       # a pair at the threshold shares no band with a chance of 2 in 10,000
AGREE = 17                # of the 36 samples; a pair at the threshold agrees in fewer with a chance of 3 in 1,000,000
COUNTERS = 1 << 20        # document frequencies are kept in so many counters, whatever the corpus
BLOCK = 1 << 14
SALT_ROWS = 1 << 9        # texts with one prefix shingle that are held against each other in one group
ROUNDING = 1e-6           # bounds are lowered by this share, so rounded sums never leave a pair out
IDF = 0.5                 # the rarest shingle weighs 1 + IDF, one that every document has weighs 1
_CELLS = 1 << 16

SKETCH = "doc_id long, key binary, bands array<long>, signs array<long>"
PREFIX = "key binary, component long, total double, shingle long, rest double"
PAIR = "a binary, b binary, similarity double"


def _gamma2() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middles of equal cells."""
    p = (np.arange(_CELLS) + 0.5) / _CELLS
    x = np.maximum(np.sqrt(2 * p), -np.log1p(-p))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / (x * np.exp(-x)), 1e-9)
    return x


class Shingles:
    """Distinct shingles of each text of a slice with their counts: text number, hash, count."""

    def __init__(self, column: pa.Array):
        buf, bounds = string_buffer(column)
        words = Words(LOWER[buf], bounds, ALNUM)
        hashes = words.hashes()
        n = len(words.counts)
        grams = run_hash(hashes, SHINGLE)
        keep = np.flatnonzero(within(words.counts, SHINGLE)[:len(grams)])
        short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))   # all its words are one shingle
        sums = running(hashes)
        whole = span_hash(sums, words.bounds[:-1], words.bounds[1:]) + words.counts.astype(np.uint64)
        text = np.concatenate((words.document()[keep], short))
        value = np.concatenate((grams[keep], mix(whole[short])))
        order = np.lexsort((value, text))
        text, value = text[order], value[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
        first = np.flatnonzero(new)
        self.text, self.value = text[first], value[first]
        self.count = np.diff(np.append(first, len(text)))
        self.bounds = np.searchsorted(self.text, np.arange(n + 1))
        second = span_hash(running(mix(hashes ^ np.uint64(0x5851F42D4C957F2D))), words.bounds[:-1], words.bounds[1:])
        self.keys = np.stack((whole, second), 1).astype(">u8")

    def key(self, k: int) -> bytes:
        """128 bits that tell the word sequence of a text."""
        return self.keys[k].tobytes()


class Sampler:
    """Weights of shingles and consistent weighted samples of texts."""

    def __init__(self, frequency: np.ndarray, documents: int):
        share = np.log((documents + 1) / np.minimum(np.maximum(frequency, 1), documents + 1))
        self.weight = (1 + IDF * share / log(documents + 2)).astype(np.float32)
        self.rate, self.log_c = _gamma2().astype(np.float32), np.log(_gamma2()).astype(np.float32)

    def weights(self, s: Shingles) -> np.ndarray:
        return s.count.astype(np.float32) * self.weight[(s.value & np.uint64(COUNTERS - 1)).astype(np.int64)]

    def prefixes(self, s: Shingles, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rarest shingles of each text: text number, hash, weight of the text, weight from the shingle on.

        Shingles stand in the order of their unit weight, then of their hash, which is the same in all texts;
        listed are those from which on a text has at least the share `least` of its weight.
        """
        unit = self.weight[(s.value & np.uint64(COUNTERS - 1)).astype(np.int64)]
        order = np.lexsort((s.value, -unit, s.text))
        weight = self.weights(s).astype(np.float64)[order]
        text, value = s.text[order], s.value[order]
        total = np.bincount(text, weight, minlength=len(s.bounds) - 1)
        sums = np.concatenate(([0.0], np.cumsum(weight)))
        rest = total[text] - (sums[:-1] - sums[s.bounds[:-1]][text])
        keep = np.flatnonzero(rest >= least * (1 - ROUNDING) * total[text])
        return text[keep], value[keep], total[text[keep]], rest[keep]

    def samples(self, s: Shingles) -> np.ndarray:
        """One row per text that has shingles; a sample is the same in two texts with the probability of
        their weighted Jaccard similarity."""
        full = np.flatnonzero(np.diff(s.bounds))
        out = np.zeros((len(full), BANDS * ROWS), np.int64)
        if not len(full):
            return out
        starts, lengths = s.bounds[full], np.diff(s.bounds)[full]
        log_w = np.log(self.weights(s))
        cell = np.uint64(_CELLS - 1)
        for k in range(BANDS * ROWS):
            u = mix(s.value + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            rate = self.rate[(u & cell).astype(np.int64)]
            shift = ((u >> np.uint64(32)) & cell).astype(np.float32) / np.float32(_CELLS)
            t = np.floor(log_w / rate + shift)
            log_a = self.log_c[((u >> np.uint64(16)) & cell).astype(np.int64)] - rate * (t - shift) - rate
            low = np.repeat(np.minimum.reduceat(log_a, starts), lengths)
            at = np.flatnonzero(log_a == low)
            at = at[np.searchsorted(at, starts)]     # the first place of the minimum in each text
            out[:, k] = mix(s.value[at] + mix(t[at].astype(np.int64).view(np.uint64) + np.uint64(k))).view(np.int64)
        return out


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per counter of hashed shingles, and documents with shingles; a table of fixed size.

    A counter holds the shingles whose hash ends in its number, so a frequent shingle stands out however
    many rare ones share its counter.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, documents = np.zeros(COUNTERS, np.int64), 0
        for batch in slices(batches):
            s = Shingles(batch.column("text"))
            total += np.bincount((s.value & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
            documents += int((np.diff(s.bounds) > 0).sum())
        if documents:
            parts = total.reshape(-1, BLOCK)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(parts)), pa.int32()), pa.array([pack(p.astype("<i4")) for p in parts]),
                 pa.array([documents] * len(parts), pa.int64())], ["block", "counts", "documents"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for part in table.column("counts"):
            total += unpack(part.as_py(), "<i4")[0]
        return pa.table({"block": table.column("block").slice(0, 1),
                         "counts": pa.array([total.astype("<i8").tobytes()], pa.binary()),
                         "documents": pa.array([sum(table.column("documents").to_pylist())], pa.int64())})

    schema = "block int, counts binary, documents long"
    rows = docs.select("text").mapInArrow(count, schema).groupBy("block").applyInArrow(add, schema).collect()
    out = np.zeros(COUNTERS, np.int64)
    for r in rows:
        out[r["block"] * BLOCK:(r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], "<i8")
    return out, max((r["documents"] for r in rows), default=0)


def band_hashes(samples: np.ndarray) -> np.ndarray:
    """One hash per text and band."""
    parts = samples.view(np.uint64).reshape(len(samples), BANDS, ROWS)
    out = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None], len(samples), 0)
    for r in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return out.view(np.int64)


def sample_signs(samples: np.ndarray) -> np.ndarray:
    """Six bits of each sample, a byte each, eight to a number; the places left over are alike in all texts."""
    out = np.zeros((len(samples), -(-samples.shape[1] // 8) * 8), np.uint8)
    out[:, :samples.shape[1]] = samples.astype(np.uint8) & 0x3F
    return out.view("<i8")


def _agree(a: str, b: str) -> Column:
    """Whether the signs of two texts differ in at most BANDS * ROWS - AGREE places.

    Equal samples have equal signs; unequal ones have them once in 64, which only lets a pair through.
    """
    differing = F.lit(0)
    for k in range(-(-BANDS * ROWS // 8)):          # a byte that is not zero carries into its seventh bit
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k]) + F.lit(0x3F3F3F3F3F3F3F3F)
        differing = differing + F.bit_count(x.bitwiseAND(F.lit(0x4040404040404040)))
    return differing <= BANDS * ROWS - AGREE


def _lists(rows: np.ndarray, filled: np.ndarray) -> pa.ListArray:
    """A list for each text; an empty one where it is not filled."""
    bounds = np.concatenate(([0], np.cumsum(filled * rows.shape[1])))
    return pa.ListArray.from_arrays(bounds.astype(np.int32), np.ascontiguousarray(rows).ravel())


def _sketcher(shared: Broadcast):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = Shingles(batch.column("text"))
            samples = shared.value.samples(s)
            filled = np.diff(s.bounds) > 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([s.key(k) for k in range(batch.num_rows)], pa.binary()),
                 _lists(band_hashes(samples), filled), _lists(sample_signs(samples), filled)],
                ["doc_id", "key", "bands", "signs"])
    return sketch


def similarities(sampler: Sampler, a: pa.Array, b: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts; 0 where neither has words."""
    n = len(a)
    s = Shingles(pa.concat_arrays([a.cast(pa.large_string()), b.cast(pa.large_string())]))
    weight = sampler.weights(s).astype(np.float64)
    pair = s.text % n
    order = np.lexsort((s.value, pair))
    pair, value, weight = pair[order], s.value[order], weight[order]
    both = np.flatnonzero((pair[1:] == pair[:-1]) & (value[1:] == value[:-1]))
    common = np.bincount(pair[both], np.minimum(weight[both], weight[both + 1]), minlength=n)
    total = np.bincount(pair, weight, minlength=n)
    return common / np.maximum(total - common, 1e-300)


def _verifier(shared: Broadcast, least: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "text_a"), "text_b"):
            found = similarities(shared.value, batch.column("text_a"), batch.column("text_b"))
            keep = np.flatnonzero(found >= least)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep)),
                 pa.array(found[keep], pa.float64())], ["a", "b", "similarity"])
    return verify


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text is the one that their key names (a doc_id may have several texts)."""
    for batch in slices(batches):
        s = Shingles(batch.column("text"))
        own = np.flatnonzero([s.key(k) == key for k, key in enumerate(batch.column("key").to_pylist())])
        yield batch.take(pa.array(own)).select(["key", "text"])


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document id: doc_id, class_id (the smallest id of its class) and how many ids the class has.

    Texts are their lower-cased words. Documents with the same words are one node from the start, however
    many they are. A node's shingles (five words; all words of a shorter text) weigh their count times a
    mild inverse document frequency; 36 consistent weighted samples in 12 bands propose links. In every
    band bucket each node is held against the bucket's smallest node. Pairs that agree in fewer than AGREE of their
    samples are left out; the others are verified by the weighted Jaccard similarity of whole texts. Where verified
    links leave a bucket in several classes, its pairs of different classes are left out only by their samples or by a
    bound on their rarest shingles, and verified otherwise. Classes are the connected components.

    Texts without words (NULL, empty, signs only) are one class. Rows without a doc_id are left out; rows that
    repeat a doc_id are one document, in the class of the smallest id that any of its texts reaches; an empty
    table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = (docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
            .where("doc_id is not null"))
    shared = spark.sparkContext.broadcast(Sampler(*frequencies(docs)))
    sketch = written(docs.mapInArrow(_sketcher(shared), SKETCH), "sketch")
    nodes = written(sketch.where(F.size("bands") > 0).groupBy("key").agg(
        F.min("doc_id").alias("first"), F.any_value("bands").alias("bands"), F.any_value("signs").alias("signs")), "nodes")
    held = nodes.select("key", "first", F.explode("bands").alias("band"))
    several = written(held.groupBy("band").count().where("count > 1").select("band"), "bands")
    buckets = written(held.join(several, "band"), "buckets")
    centres = buckets.groupBy("band").agg(F.min(F.struct("first", "key")).alias("centre"))
    members = written(buckets.join(centres, "band").select("band", "key", "first", F.col("centre.key").alias("centre")),
                      "members")

    texts = written(_texts(docs, members), "texts")

    links = written(_verified(_likely(members.where("key != centre").select(
        F.col("centre").alias("a"), F.col("key").alias("b")).distinct(), nodes), texts, shared, similarity), "links")
    further = _likely(_contested(texts, members, components(links), shared, similarity), nodes, True)
    links = written(links.unionByName(_verified(further, texts, shared, similarity)), "links")
    found = components(links)
    own = sketch.select("doc_id", "key").join(
        found.select(F.col("node").alias("key"), "component"), "key", "left").withColumn(
        "component", F.coalesce("component", "key"))
    lowest = written(own.groupBy("component").agg(F.min("doc_id").alias("class_id"),
                                                  F.countDistinct("doc_id").alias("class_size")), "classes")
    return (own.join(lowest, "component").groupBy("doc_id")
            .agg(F.min(F.struct("class_id", "class_size")).alias("c"))
            .select("doc_id", "c.class_id", "c.class_size"))


def _texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """key, text of the nodes that share a bucket with another; the only step that meets documents with nodes."""
    wanted = members.select(F.col("first").alias("doc_id"), "key").distinct()
    rows = attach(docs, wanted, ["doc_id"], "inner").select("key", "text")
    return rows.mapInArrow(_keyed, "key binary, text string").groupBy("key").agg(F.any_value("text").alias("text"))


def _likely(pairs: DataFrame, nodes: DataFrame, banded: bool = False) -> DataFrame:
    """The pairs (a, b) that agree in enough samples and, where asked for, in a band."""
    held = nodes.select("key", "signs", *["bands"][:banded])
    pairs = (pairs.join(held.select(*[F.col(c).alias(f"{c}_a") for c in held.columns]), F.col("a") == F.col("key_a"))
             .join(held.select(*[F.col(c).alias(f"{c}_b") for c in held.columns]), F.col("b") == F.col("key_b")))
    like = _agree("signs_a", "signs_b")
    return written(pairs.where(like & F.arrays_overlap("bands_a", "bands_b") if banded else like).select("a", "b"), "likely")


def _verified(pairs: DataFrame, texts: DataFrame, shared: Broadcast, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are alike, with their similarity."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    texts = written(attach(texts, keys, ["key"], "left_semi"), "pair-texts")
    left = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(
        _verifier(shared, least), PAIR)


def _prefixer(shared: Broadcast, least: float):
    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = Shingles(batch.column("text"))
            text, value, total, rest = shared.value.prefixes(s, least)
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(at), batch.column("component").take(at), pa.array(total, pa.float64()),
                 pa.array(value.view(np.int64), pa.int64()), pa.array(rest, pa.float64())],
                ["key", "component", "total", "shingle", "rest"])
    return prefix


def _contested(texts: DataFrame, members: DataFrame, found: DataFrame, shared: Broadcast, least: float) -> DataFrame:
    """Pairs (a, b) of nodes of split buckets, of different classes, that no bound keeps below the similarity.

    The rarest shingles of a text that make up a share of 1 - similarity of its weight are its prefix. Of two
    texts that are alike, the first shingle in common (in order of weight) lies in the prefix of the heavier one
    and in the rarest 1 - 2 similarity / (1 + similarity) of the lighter one, and what either has from there on
    is enough for the similarity. Pairs without such a shingle are left out for certain, all others are listed;
    a passage that thousands share is in no prefix of texts that have enough rare shingles besides.
    Shingles that many texts have are dealt over SALT_ROWS rows each.
    """
    own = members.join(found.select(F.col("node").alias("key"), "component"), "key", "left").select(
        "band", "key", F.xxhash64(F.coalesce("component", "key")).alias("component"))
    own = written(own, "own-classes")
    split = (own.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"))
             .where("low <> high").select("band"))
    mixed = own.join(split, "band").select("key", "component").distinct()
    prefix = written(attach(texts, mixed, ["key"], "inner").mapInArrow(_prefixer(shared, least), PREFIX), "prefixes")
    hot = (prefix.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                         F.count("*").alias("n"))
           .where("low <> high").select("shingle", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts")))
    both = written(prefix.join(hot, "shingle"), "shared-prefixes")
    part = 2 * least / (1 + least) * (1 - ROUNDING)
    columns = ("key", "component", "total", "rest")
    light = both.where(F.col("rest") >= part * F.col("total")).select(
        "shingle", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        *[F.col(c).alias(f"{c}_a") for c in columns])
    heavy = both.select(
        "shingle", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int").alias("salt"),
        *[F.col(c).alias(f"{c}_b") for c in columns])
    enough = least / (1 + least) * (1 - ROUNDING) * (F.col("total_a") + F.col("total_b"))
    pairs = light.join(heavy, ["shingle", "salt"]).where(
        (F.col("component_a") != F.col("component_b"))
        & (F.struct("total_a", "key_a") < F.struct("total_b", "key_b"))
        & (F.col("total_a") >= least * (1 - ROUNDING) * F.col("total_b"))
        & (F.least("rest_a", "rest_b") >= enough))
    return pairs.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct()
