"""Packed token ids as matrices: best fit decreasing, tightest room found in a segment tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tickflow.llm.tokens import definition, encoder
from tickflow.llm.words import slices

CAPACITY = 2048
END, PAD = 2, 0
GROUP_IDS = 4_000_000     # ids that a task packs together
SCHEMA = ("sequence_id long, n_ids int, ids binary, cu_seqlens array<int>, position_resets array<int>, "
          "doc_ids array<long>, starts array<long>")


class Rooms:
    """Open sequences by the room they have left; the tightest that still fits is found in log time.

    A segment tree over all rooms 0..capacity; a node counts the open sequences below it.
    """

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._shift(room, 1)

    def _shift(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """(room, sequence) of the tightest open sequence with at least this room; it is taken out."""
        count, node = self.count, self.leaves + length
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):     # up, until a right neighbour holds one
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        sequence = self.open[room].pop()
        self._shift(room, -1)
        return room, sequence


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Members of each sequence, by best fit decreasing (ties in the order given)."""
    rooms, members = Rooms(capacity), []
    for k in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[k])
        found = rooms.take(length)
        if found is None:
            members.append([])
            found = capacity, len(members) - 1
        room, sequence = found
        members[sequence].append(k)
        if room > length:
            rooms.add(room - length, sequence)
    return members


class _Packer:
    def __init__(self, capacity: int, pad: int):
        self.capacity, self.pad = capacity, pad
        self.pieces: list[tuple[int | None, int, np.ndarray]] = []
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        for start in range(0, len(ids), self.capacity):
            self.pieces.append((doc_id, start, ids[start:start + self.capacity].copy()))
        self.size += len(ids)

    def flush(self, last: bool) -> Iterator[tuple]:
        """Full enough sequences; what lies in the others waits for more documents, unless this is the last call."""
        members = best_fit(np.array([len(p[2]) for p in self.pieces], np.int64), self.capacity)
        waiting = []
        for own in members:
            rows = [self.pieces[k] for k in own]
            total = sum(len(r[2]) for r in rows)
            if not last and total < self.capacity * 15 // 16:
                waiting += rows
                continue
            ends = np.cumsum([0] + [len(r[2]) for r in rows])
            ids = np.full(self.capacity, self.pad, "<u4")
            ids[:total] = np.concatenate([r[2] for r in rows])
            yield (total, ids.tobytes(), ends.tolist(), ends[:-1].tolist(), [r[0] for r in rows], [r[1] for r in rows])
        self.pieces, self.size = waiting, sum(len(p[2]) for p in waiting)


def packed_ids(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, pad: int = PAD,
               group_ids: int = GROUP_IDS) -> DataFrame:
    """One row per sequence: its matrix row of `capacity` little-endian unsigned 32-bit ids (padded),
    cumulative segment lengths, where positions start again at 0, and each segment's document and place in it.

    Each task packs its own documents, some millions of ids at a time, so ids are never shuffled; sequences
    left emptier than 15/16 wait for the task's next documents. Longer documents are cut every `capacity`
    ids; `doc_ids` and `starts` put them together again without loss.

    NULL and empty texts are the end id alone; rows with a NULL or repeated doc_id are segments like others;
    an empty table gives no sequences; other columns are ignored. sequence_id is the task's number and a count.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition(tokenizer))
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()),
             pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = ["sequence_id", "n_ids", "ids", "cu_seqlens", "position_resets", "doc_ids", "starts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode
        base = TaskContext.get().partitionId() << 33
        packer, done = _Packer(capacity, pad), 0

        def rows(found: list[tuple], first: int) -> pa.RecordBatch:
            columns = [range(base + first, base + first + len(found)), *zip(*found)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        def emit(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal done
            found: list[tuple] = []
            for row in packer.flush(last):
                found.append(row)
                if len(found) * capacity * 4 >= 8_000_000:
                    yield rows(found, done)
                    done, found = done + len(found), []
            if found:
                yield rows(found, done)
                done += len(found)

        for batch in slices(batches, size=4_000_000):
            ids, counts = encode([t or "" for t in batch.column("text").to_pylist()])
            at = 0
            for doc_id, n in zip(batch.column("doc_id").to_pylist(), counts.tolist()):
                packer.add(doc_id, np.append(ids[at:at + n], end).astype("<u4"))
                at += n
            if packer.size >= group_ids:
                yield from emit(False)
        if packer.pieces:
            yield from emit(True)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, SCHEMA)


def positions(cu_seqlens: list[int]) -> np.ndarray:
    """Position of every id in its own segment."""
    ends = np.asarray(cu_seqlens)
    return np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))


def write_matrices(packed: DataFrame, path: str) -> None:
    """The rows as Parquet files, in the folder given."""
    packed.write.mode("errorifexists").parquet(path)
