"""Which hashes of one piece of the corpus occur in documents of another: a two-way exchange in packed rows.

The documents are written once as compressed pieces of a few megabytes, in a table bucketed by the task
that wrote them, so later stages meet their answers without moving text again. A piece sends each of its
distinct hashes once, with the smallest document that holds it, to the shard of the hash; the answer is one
bit per hash. So a hash that a third of all documents hold costs its shard one entry per piece.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.llm.words import return_memory, slices
from tickflow.runtime import new_path

PIECE_BYTES = 2_500_000
SHARD_ENTRIES = 1_000_000         # entries that one task compares at once, about
KEPT = 7                          # bytes of a hash that are sent; the shard number tells bits beyond them
ENTRIES = "shard int, part int, piece int, n long, hashes binary, docs binary"
ANSWERS = "part int, piece int, shard int, n long, bits binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes."""
    head = np.array([len(arrays), *(len(a) * a.itemsize for a in arrays)], "<i8").tobytes()
    body = head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    body = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    sizes = np.frombuffer(body, "<i8", len(kinds) + 1)[1:]
    out, at = [], 8 * (len(kinds) + 1)
    for kind, size in zip(kinds, sizes.tolist()):
        out.append(np.frombuffer(body[at:at + size], kind))
        at += size
    return out


@dataclass
class Piece:
    """Documents of one piece in ascending order of their ids; those without an id come last."""

    part: int
    piece: int
    doc_id: pa.Array
    text: pa.Array

    def ids(self) -> np.ndarray:
        return self.doc_id.drop_null().to_numpy(zero_copy_only=False)


@dataclass
class Parts:
    """The table of pieces and how it is cut."""

    table: DataFrame
    pieces: int


def _blob(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    body = sink.getvalue()
    return body.size.to_bytes(8, "little") + pa.Codec("zstd", 5).compress(body, asbytes=True)


def open_piece(part: int, piece: int, blob: bytes) -> Piece:
    body = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd")
    table = pa.ipc.open_stream(body).read_all().combine_chunks()
    return Piece(part, piece, table.column("doc_id").combine_chunks(), table.column("text").combine_chunks())


def pieces_of(table: pa.Table | pa.RecordBatch) -> Iterator[Piece]:
    for part, piece, blob in zip(*(table.column(n) for n in ("part", "piece", "blob"))):
        yield open_piece(part.as_py(), piece.as_py(), blob.as_py())


def parts(docs: DataFrame, piece_bytes: int = PIECE_BYTES) -> Parts:
    """doc_id and text as pieces, written to the shared folder and bucketed by the writing task."""
    spark = docs.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece = TaskContext.get().partitionId(), 0
        for batch in slices(batches, size=piece_bytes):
            order = pa.compute.sort_indices(batch, sort_keys=[("doc_id", "ascending")], null_placement="at_end")
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([piece], pa.int32()),
                 pa.array([_blob(batch.take(order))], pa.binary())], ["part", "piece", "blob"])
            piece += 1

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    buckets = max(rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    name = f"pieces_{uuid.uuid4().hex}"
    (rows.mapInArrow(cut, "part int, piece int, blob binary").write.bucketBy(buckets, "part").sortBy("part")
     .option("path", new_path(spark, "pieces")).format("parquet").saveAsTable(name))
    table = spark.table(name)
    return Parts(table, table.select("part").count())


def entries(piece: Piece, hashes: np.ndarray, doc: np.ndarray, shards: int) -> Iterator[tuple]:
    """Rows for the shards from a piece's hashes and the (ascending) place of their documents."""
    _, first = np.unique(hashes, return_index=True)
    first.sort()                                     # first places only: the smallest document of each hash
    hashes, doc = hashes[first], doc[first]
    shard = shard_of(hashes, shards)
    order = np.argsort(shard.astype(np.uint16) if shards <= 65536 else shard, kind="stable")
    used, starts = np.unique(shard[order], return_index=True)
    ids = piece.ids()
    for s, own in zip(used.tolist(), np.split(order, starts[1:])):       # only shards that the piece has hashes of
        at, count = np.unique(doc[own], return_counts=True)
        low = hashes[own].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT]
        yield (s, piece.part, piece.piece, len(own), low.tobytes(), pack(ids[at], count.astype("<i4")))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """By the upper half of the hash, so that the bytes dropped from an entry are told by its shard."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def entry_batches(rows: Iterator[tuple], size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    names = [c.split()[0] for c in ENTRIES.split(", ")]
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += len(row[4])
        if total >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
    return_memory()


def shard_count(total: int) -> int:
    return max(1, -(-total // SHARD_ENTRIES))


def recurring(sent: DataFrame, later: bool) -> DataFrame:
    """Per piece and shard one bit for each entry: with `later`, whether a smaller document holds the hash;
    else whether any other document does."""
    def compare(table: pa.Table) -> pa.Table:
        counts = table.column("n").to_numpy()
        low = np.concatenate([np.frombuffer(h.as_py(), np.uint8) for h in table.column("hashes")])
        wide = np.zeros((len(low) // KEPT, 8), np.uint8)
        wide[:, :KEPT] = low.reshape(-1, KEPT)
        hashes = wide.view("<u8").ravel()
        doc = np.concatenate([np.repeat(*unpack(d.as_py(), "<i8", "<i4")) for d in table.column("docs")])
        order = np.argsort(hashes, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = hashes[order[1:]] != hashes[order[:-1]]
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, len(order)))
        least = np.minimum.reduceat(doc[order], starts)
        found = np.empty(len(order), bool)
        if later:
            found[order] = doc[order] > np.repeat(least, lengths)
        else:
            found[order] = np.repeat(np.maximum.reduceat(doc[order], starts) > least, lengths)
        bits = [pack(np.packbits(x)) for x in np.split(found, np.cumsum(counts)[:-1])]
        return_memory()
        return pa.table({"part": table.column("part"), "piece": table.column("piece"), "shard": table.column("shard"),
                         "n": table.column("n"), "bits": pa.array(bits, pa.binary())})

    return sent.groupBy("shard").applyInArrow(compare, ANSWERS)


class Answers:
    """The answers for one task's pieces."""

    def __init__(self, table: pa.Table):
        self.of: dict[tuple[int, int], dict[int, np.ndarray]] = {}
        for part, piece, shard, n, bits in zip(*(table.column(c).to_pylist()
                                                 for c in ("part", "piece", "shard", "n", "bits"))):
            flags = np.unpackbits(unpack(bits, np.uint8)[0], count=n).astype(bool)
            self.of.setdefault((part, piece), {})[shard] = flags

    def flagged(self, piece: Piece, hashes: np.ndarray, shards: int) -> np.ndarray:
        """The distinct hashes of the piece whose bit is set, ascending; `hashes` as given to `entries`."""
        _, first = np.unique(hashes, return_index=True)
        first.sort()
        own = hashes[first]
        found = self.of.get((piece.part, piece.piece), {})
        order = np.argsort(shard_of(own, shards), kind="stable")         # as `entries` has sent them, shard by shard
        flags = np.zeros(len(own), bool)
        if found:
            flags[order] = np.concatenate([found[s] for s in sorted(found)])
        return np.sort(own[flags])


def shared_inside(hashes: np.ndarray, doc_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, and the smallest and largest document of each within the piece."""
    order = np.lexsort((doc_id, hashes))
    h, d = hashes[order], doc_id[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(h)) - 1
    return h[starts], np.stack((d[starts], d[ends]), 1) if len(starts) else np.empty((0, 2), np.int64)


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each value is in the ascending table."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def with_answers(found: Parts, answers: DataFrame, run: Callable[[Iterator[Piece], pa.Table], pa.Table],
                 schema: str) -> DataFrame:
    """One call per writing task with its pieces and its answers; the pieces are not shuffled."""
    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(pieces_of(left), right)
        return_memory()
        return out

    return found.table.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(both, schema)
