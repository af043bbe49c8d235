"""Line deduplication by pairwise alignment: documents that share rare lines are aligned by patience diff."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.llm.words import Words, byte_table, mix, running, slices, span_hash, string_buffer
from tickflow.runtime import written

RARE_SHARE = 0.001        # a line is rare in at most this share of the different texts
RARE_LEAST = 10           # or in so many, whichever is more

NOT_NEWLINE = byte_table(lambda b: b != 0x0A)
LINES = "doc_id long, key binary, lines array<long>"
TABLE_BITS = 1 << 28      # of one alignment table; longer sequences are halved


def text_lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Hashes of the lines that are not empty, their bounds by text, and 128 bits that tell each text's lines."""
    lines = Words(*string_buffer(column), NOT_NEWLINE)
    values = lines.hashes()
    keys = np.stack([span_hash(running(v), lines.bounds[:-1], lines.bounds[1:])
                     for v in (values, mix(values ^ np.uint64(0x5851F42D4C957F2D)))], 1)
    return values.view(np.int64), lines.bounds, [row.tobytes() for row in keys]


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        values, bounds, whole = text_lines(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(whole, pa.binary()),
             pa.ListArray.from_arrays(bounds.astype(np.int32), values)], ["doc_id", "key", "lines"])


def _rising(values: list[int]) -> list[int]:
    """Indices of a longest strictly rising subsequence."""
    tails: list[int] = []
    tops: list[int] = []
    back: list[int] = []
    for k, v in enumerate(values):
        at = bisect_left(tops, v)
        back.append(tails[at - 1] if at else -1)
        if at == len(tails):
            tails.append(k)
            tops.append(v)
        else:
            tails[at], tops[at] = k, v
    out = []
    k = tails[-1] if tails else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def _states(a: Sequence[int], b: Sequence[int]) -> Iterator[int]:
    """After each element of a, a number whose zero bits mark where a longest common subsequence with b's head grows."""
    at: dict[int, int] = {}
    for k, v in enumerate(b):
        at[v] = at.get(v, 0) | 1 << k
    full = state = (1 << len(b)) - 1
    for v in a:
        hit = state & at.get(v, 0)
        state = (state + hit | state - hit) & full
        yield state


def _head_lengths(a: Sequence[int], b: Sequence[int]) -> np.ndarray:
    """Length of a longest common subsequence of a and b[:k] for every k."""
    state = (1 << len(b)) - 1
    for state in _states(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(state.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")
    return np.concatenate(([0], np.cumsum(1 - bits[:len(b)].astype(np.int64))))


def common_order(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Places in b of a longest common subsequence of a and b."""
    if not set(a) & set(b):
        return []
    if len(a) > 1 and len(a) * len(b) > TABLE_BITS:
        half = len(a) // 2
        cut = int(np.argmax(_head_lengths(a[:half], b) + _head_lengths(a[half:][::-1], b[::-1])[::-1]))
        return common_order(a[:half], b[:cut]) + [cut + k for k in common_order(a[half:], b[cut:])]
    size = len(b) // 8 + 1
    rows = [state.to_bytes(size, "little") for state in _states(a, b)]
    out, i, j = [], len(a), len(b)
    while i and j:
        byte, bit = j - 1 >> 3, j - 1 & 7
        if rows[i - 1][byte] >> bit & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1][byte] >> bit & 1:
            j -= 1
            out.append(j)
    return out[::-1]


def patience(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Places in b of the lines that a patience diff aligns with lines of a.

    Equal heads and tails are aligned; between them the lines that either side has once are matched in the
    longest common order, and the gaps between matches are treated the same way. A gap without such a line is
    aligned by a longest common subsequence.
    """
    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append(b0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append(b1)
        if a0 == a1 or b0 == b1:
            continue
        once: dict[int, int] = {}
        for k in range(a0, a1):
            once[a[k]] = -1 if a[k] in once else k
        seen: dict[int, int] = {}
        for k in range(b0, b1):
            seen[b[k]] = -1 if b[k] in seen else k
        common = sorted((k, once[v]) for v, k in seen.items() if k >= 0 and once.get(v, -1) >= 0)
        chain = [common[k] for k in _rising([at for _, at in common])]
        if not chain:
            out += [b0 + k for k in common_order(a[a0:a1], b[b0:b1])]
            continue
        last_a, last_b = a0, b0
        for kb, ka in chain:
            out.append(kb)
            todo.append((last_a, ka, last_b, kb))
            last_a, last_b = ka + 1, kb + 1
        todo.append((last_a, a1, last_b, b1))
    return sorted(out)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places = [patience(a, b) for a, b in zip(batch.column("earlier_lines").to_pylist(),
                                                 batch.column("lines").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(places, pa.list_(pa.int32()))],
                                         ["key", "places"])


def leads(texts: DataFrame) -> DataFrame:
    """key, line, n, earlier: for every line that different texts share, how many hold it and the first one that does."""
    held = texts.select("key", "first", F.explode(F.array_distinct("lines")).alias("line"))
    shared = (held.groupBy("line").agg(F.count("*").alias("n"), F.min(F.struct("first", "key")).alias("owner"))
              .where("n > 1"))
    return (held.join(shared, "line").where(F.col("key") != F.col("owner.key"))
            .select("key", "line", "n", F.col("owner.key").alias("earlier")))


def aligned(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """key and the places of the lines that an alignment with an earlier text covers, one row a pair."""
    lines = texts.select("key", "lines")
    both = pairs.join(lines, "key").join(
        lines.select(F.col("key").alias("earlier"), F.col("lines").alias("earlier_lines")), "earlier")
    return both.select("key", "lines", "earlier_lines").mapInArrow(_aligned, "key binary, places array<int>")


def _gathered(found: DataFrame) -> DataFrame:
    return found.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, line = [], []
        for name, lines, places in zip(batch.column("key"), batch.column("lines"), batch.column("places")):
            values = np.asarray(lines.values)
            open_ = np.ones(len(values), bool)
            if places.is_valid:
                open_[np.asarray(places.values)] = False
            rest = np.unique(values[open_])
            key += [name.as_py()] * len(rest)
            line.append(rest)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key, pa.binary()), pa.array(np.concatenate(line) if line else [], pa.int64())], ["key", "line"])


def covered_places(listed: DataFrame, rare_share: float = RARE_SHARE, rare_least: int = RARE_LEAST) -> DataFrame:
    """key, places: the lines of each text that alignments with earlier texts cover.

    First a text is led to its partners by its rare shared lines or, where it has none, by the rarest it shares.
    Then every line that is left and that an earlier text holds leads to its first holder, however many hold it.
    So each shared line has been aligned with its first holder, or is covered already; pairs never outnumber lines.
    """
    texts = listed.groupBy("key").agg(F.min("doc_id").alias("first"), F.any_value("lines").alias("lines"))
    texts = written(texts, "line-texts")
    rare = max(rare_least, int(rare_share * texts.count()))
    led = written(leads(texts), "led")
    rarest = led.groupBy("key").agg(F.min("n").alias("least"))
    pairs = written(led.join(rarest, "key").where((F.col("n") <= rare) | (F.col("n") == F.col("least")))
                    .select("key", "earlier").distinct(), "line-pairs")
    found = written(_gathered(aligned(pairs, texts)), "line-places")
    left = (texts.join(rarest.select("key"), "key").join(found, "key", "left").select("key", "lines", "places")
            .mapInArrow(_left, "key binary, line long"))
    more = (led.join(left, ["key", "line"]).select("key", "earlier").distinct()
            .join(pairs, ["key", "earlier"], "left_anti"))
    return _gathered(found.unionByName(aligned(written(more, "line-pairs"), texts)))


def removed_lines(docs: DataFrame, rare_share: float = RARE_SHARE, rare_least: int = RARE_LEAST) -> DataFrame:
    """doc_id, key, whole (an earlier document has the same lines) and places of the lines to delete."""
    listed = written(docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
                     .where("doc_id is not null").mapInArrow(_listed, LINES).where("size(lines) > 0"), "lines")
    cut = covered_places(listed, rare_share, rare_least)
    first = listed.groupBy("key").agg(F.min("doc_id").alias("first"))
    own = listed.select("doc_id", "key").distinct().join(first, "key").join(cut, "key", "left")
    return own.select("doc_id", "key", (F.col("doc_id") > F.col("first")).alias("whole"), "places").where(
        "whole or size(places) > 0")


def kept_text(text: str, whole: bool, places: list[int]) -> tuple[str, int, int]:
    """The text without the lines at these places among its lines that are not empty; their numbers."""
    pieces = text.split("\n")
    full = [k for k, piece in enumerate(pieces) if piece]
    gone = set(full) if whole else {full[p] for p in places}
    return "\n".join(piece for k, piece in enumerate(pieces) if k not in gone), len(full), len(gone)


def _cutter(names: list[str], marked: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, _, keys = text_lines(batch.column("text"))
            texts = batch.column("text").to_pylist()
            marks = batch.column(marked).to_pylist()
            rows = []
            for text, key, found in zip(texts, keys, marks):
                mark = next((m for m in found or () if m["key"] == key), None)
                new, lines, gone = kept_text(text or "", bool(mark and mark["whole"]),
                                             (mark["places"] or []) if mark else [])
                rows.append((text if text is None or not gone else new, lines, gone))
            text, lines, gone = zip(*rows)
            columns = [pa.array(text, pa.string()) if n == "text" else batch.column(n) for n in names]
            columns += [pa.array(lines, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "__n_lines", "__n_removed"])
    return cut


def dedup_lines(docs: DataFrame, rare_share: float = RARE_SHARE, rare_least: int = RARE_LEAST) -> DataFrame:
    """All rows and columns of docs, the text without lines that an earlier document has, and the columns
    __n_lines (lines that are not empty) and __n_removed.

    Documents that share lines are aligned by a patience diff, led by rare lines first (see `covered_places`), and
    what is aligned goes from the document with the larger id. Alignments use the texts as they came. A shared line
    stays only where it stands in another order than in the documents that it was aligned with.
    A document with the very lines of an earlier one loses all of them.

    NULL stays NULL and has no lines; empty lines and texts stay; rows without a doc_id stay as they are and are
    no partner; rows that repeat a doc_id with the same text are one document and stay alike; other columns pass
    through, but for those named like the two new ones, which are replaced; an empty table gives an empty result.
    """
    docs = docs.drop("__n_lines", "__n_removed")
    own_id, marked = ("_" * max(map(len, docs.columns)) + name for name in ("id", "marks"))     # longer than any column
    marks = removed_lines(docs, rare_share, rare_least).groupBy("doc_id").agg(
        F.collect_list(F.struct("key", "whole", "places")).alias(marked)).withColumnRenamed("doc_id", own_id)
    joined = docs.withColumn("text", F.col("text").cast("string")).join(
        marks, F.col("doc_id").cast("long") == F.col(own_id), "left").drop(own_id)
    schema = docs.withColumn("text", F.col("text").cast("string")).schema.add("__n_lines", "long").add(
        "__n_removed", "long")
    return joined.mapInArrow(_cutter(docs.columns, marked), schema)


def contract(found: DataFrame) -> DataFrame:
    """The columns of `op7_line_dedup`."""
    return found.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"),
                        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
