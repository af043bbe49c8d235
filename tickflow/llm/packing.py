"""Packing of tokenised documents by linear grouping: lengths are planned on their histogram only.

The driver sees one count per length (at most `capacity` of them), plans the packing for whole runs of
equally long pieces and sends back a table of runs whose size depends on the capacity and the number
of groups, never on the number of documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickflow.llm.tokens import definition, encoder
from tickflow.llm.words import slices
from tickflow.runtime import written

CAPACITY = 1024
END = 2
GROUPS = 1000             # groups of equal cardinality that large lengths are rounded up in
PIECE_BYTES = 500_000     # text encoded at once; its code points, hashes and marks take about forty times as much
SMALL = 1 / 16            # lengths up to this share of the capacity are packed last, best fit

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
RUNS = "length long, first long, last long, sequence long, width long, place long"


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; the first piece is the shorter one."""
    head = n % capacity if n > capacity else n
    return ([(0, head)] if head else []) + [(a, capacity) for a in range(head, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: its ids' checksum and its number among the equally long ones of its task."""
    shared = docs.sparkSession.sparkContext.broadcast(definition(tokenizer))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, size=PIECE_BYTES):
            names = batch.column("doc_id").to_pylist()
            ids, counts = encode([t or "" for t in batch.column("text").to_pylist()])
            rows: list[tuple] = []
            at = 0
            for name, n in zip(names, counts.tolist()):
                own = np.append(ids[at:at + n], end).astype("<u4")
                at += n
                for piece, (start, length) in enumerate(cuts(n + 1, capacity)):
                    rows.append((name, piece, start, length, zlib.crc32(own[start:start + length].tobytes()),
                                 part, int(seen[length])))
                    seen[length] += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*rows), types)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(cut, PIECES)


def configurations(sizes: list[int], need: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Ways to fill a sequence and how often to use each; `sizes` descending, none used more than needed.

    Each way holds the largest size that is left and fills the room beside it as full as the other sizes
    can (a knapsack over at most `capacity` rooms), with larger ones before smaller ones among equal
    fillings. It is used until one of its sizes runs short, so there are about as many ways as sizes;
    pieces that no whole way takes are left over.
    """
    size, left = np.array(sizes), np.array(need)
    found = []
    while True:
        alive = np.flatnonzero(left > 0)
        if not len(alive):
            return found
        first = alive[0]
        ways = np.zeros(len(size), int)
        ways[first] = 1
        for k in _fill(size, left - ways, capacity - size[first]):
            ways[k] += 1
        times = int((left[ways > 0] // ways[ways > 0]).min())
        found.append((ways.tolist(), times))
        left = left - times * ways


def _fill(size: np.ndarray, left: np.ndarray, room: int) -> list[int]:
    """Indices of sizes, repeated as often as taken, whose sum comes closest to the room."""
    usable = np.flatnonzero((left > 0) & (size <= room))
    took = np.full(room + 1, -1)                     # the size that first reached this sum; larger ones come first
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    for k in usable:
        step = int(size[k])
        times = min(int(left[k]), room // step)
        new = reached.copy()
        for _ in range(times):
            more = np.zeros(room + 1, bool)
            more[step:] = new[:-step]
            more &= ~new
            if not more.any():
                break
            took[more] = k
            new |= more
        reached = new
        if reached[room]:
            break
    at, taken = int(np.flatnonzero(reached)[-1]), []
    while at:
        taken.append(int(took[at]))
        at -= int(size[took[at]])
    return taken


class Plan:
    """Runs (length, first, last, sequence, width, place): ranks first..last-1 of a length go one by one
    into `width` sequences from `sequence` on, and round again behind the earlier ones."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self.free: dict[int, list[tuple[int, int]]] = {}     # room left -> (first sequence, count)

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def leave(self, room: int, first: int, count: int) -> None:
        if room > 0 and count > 0:
            self.free.setdefault(room, []).append((first, count))


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> Plan:
    """Linear grouping of the large lengths, configurations, substitution, then best fit of what is left.

    Left are the small lengths and the pieces that whole multiples of the configurations don't take.
    """
    out = Plan(capacity)
    full = histogram.get(capacity, 0)
    if full:
        out.runs.append((capacity, 0, full, out.open(full), full, 0))
    limit = int(capacity * small)
    large = sorted((n for n in histogram if limit < n < capacity and histogram[n]), reverse=True)
    queues = _groups(large, histogram, groups)
    if queues:
        sizes = sorted(queues, reverse=True)
        need = [sum(b - a for _, a, b in queues[s]) for s in sizes]
        for counts, times in configurations(sizes, need, capacity):
            slots = [s for s, c in zip(sizes, counts) for _ in range(c)]
            _substitute(out, queues, slots, times)
    rest = [run for queue in queues.values() for run in queue]
    rest += [(n, 0, histogram[n]) for n in histogram if n <= limit and histogram[n]]
    for length, first, last in sorted(rest, reverse=True):
        _best_fit(out, length, first, last)
    return out


def _groups(large: list[int], histogram: dict[int, int], groups: int) -> dict[int, list[tuple[int, int, int]]]:
    """Rounded size -> (length, first rank, last rank) of its actual pieces, longest first."""
    total = sum(histogram[n] for n in large)
    each = max(1, -(-total // groups))
    queues: dict[int, list[tuple[int, int, int]]] = {}
    size, room = 0, 0
    for length in large:
        at = 0
        while at < histogram[length]:
            if room == 0:
                size, room = length, each
            take = min(room, histogram[length] - at)
            queues.setdefault(size, []).append((length, at, at + take))
            at, room = at + take, room - take
    return queues


def _substitute(out: Plan, queues: dict, slots: list[int], times: int) -> None:
    """`times` sequences of one configuration; each slot takes the next actual pieces of its size.

    Sequences that nothing is left for are not opened: only the last ones of a size can lack pieces.
    """
    left = {s: sum(b - a for _, a, b in queues[s]) for s in set(slots)}
    times = min(times, max(-(-left[s] // slots.count(s)) for s in left))
    if times <= 0:
        return
    parts = [(out.open(times), times, 0)]            # (first sequence, count, ids in each)
    for slot in slots:
        queue, after = queues[slot], []
        for first, count, used in parts:
            while count and queue:
                length, a, b = queue[0]
                take = min(count, b - a)
                out.runs.append((length, a, a + take, first, take, used))
                after.append((first, take, used + length))
                first, count = first + take, count - take
                if a + take == b:
                    queue.pop(0)
                else:
                    queue[0] = (length, a + take, b)
            if count:
                after.append((first, count, used))
        parts = after
    for first, count, used in parts:
        out.leave(out.capacity - used, first, count)


def _best_fit(out: Plan, length: int, at: int, count: int) -> None:
    """Ranks at..count-1 of one length go where the least room is left; equal rooms are filled together."""
    while at < count:
        rooms = [r for r in out.free if r >= length]
        if not rooms:
            each = out.capacity // length
            fresh = -(-(count - at) // each)
            out.leave(out.capacity, out.open(fresh), fresh)
            continue
        room = min(rooms)
        first, width = out.free[room].pop()
        if not out.free[room]:
            del out.free[room]
        each = room // length
        filled = min(width, (count - at) // each)    # sequences that get as many as fit
        if filled:
            out.runs.append((length, at, at + filled * each, first, filled, out.capacity - room))
            out.leave(room - each * length, first, filled)
            at += filled * each
        if filled < width and at < count:            # the last ones share one sequence
            rest = count - at
            out.runs.append((length, at, count, first + filled, 1, out.capacity - room))
            out.leave(room - rest * length, first + filled, 1)
            filled, at = filled + 1, count
        out.leave(room, first + filled, width - filled)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, groups: int = GROUPS) -> DataFrame:
    """Places of all pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and the end id; longer ones are cut into pieces of `capacity`, the first
    piece taking what is over. Pieces of one length are interchangeable, so each only needs its rank among
    them: its number within its task (counted while tokenising) plus the counts of the tasks before.

    NULL and empty texts are the end id alone; rows with a NULL or repeated doc_id are packed like others;
    an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, tokenizer, capacity, end), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    histogram = {int(r["length"]): int(r["n"])
                 for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    planned = plan(histogram, capacity, groups)
    runs = spark.createDataFrame(planned.runs, RUNS)
    ranked = (pieces.join(counts.select("length", "part", "before"), ["length", "part"])
              .withColumn("rank", F.col("nth") + F.col("before")))
    turn = F.col("rank") - F.col("first")
    return (ranked.join(F.broadcast(runs.withColumnRenamed("length", "run_length")),
                        (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first"))
                        & (F.col("rank") < F.col("last")))
            .select("doc_id", "piece", "start", "length", "ids_crc32",
                    (F.col("sequence") + turn % F.col("width")).alias("sequence_id"),
                    (F.col("place") + F.floor(turn / F.col("width")) * F.col("length")).cast("long").alias("offset")))
