"""Byte strings that an earlier document has, from merged Burrows-Wheeler transforms of recurring contexts.

Every window of `length` bytes is told by the smallest hash among its grams, so equal windows of any two
documents meet under the same gram. Grams of one document only are out after one exchange of hashes. The
windows under each other gram form a short context; contexts go to the bucket of their gram, where they are
indexed in shards and the shards' transforms are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.llm import exchange
from tickflow.llm.exchange import Answers, Piece, pack, unpack
from tickflow.llm.words import _BYTE, covered, mix, run_bounds, run_hash, running, span_hash, string_buffer, within
from tickflow.runtime import written

LENGTH = 50
WIDTH = 32                # grams of LENGTH - WIDTH + 1 bytes in each window; a power of two
PIECE_BYTES = 2_000_000   # of text that a task holds the windows of at once
BUCKET_BYTES = 2_500_000  # of text per bucket; contexts are a part of it, a few times over
SHARD_BYTES = 250_000     # of contexts in one transform before merging
END = 0xFF                # ends a context; no byte of UTF-8
CONTEXTS = "bucket int, part int, piece int, n long, contexts binary"
ANSWERS = "part int, piece int, shard int, n long, bits binary"
RESULT = "doc_id long, n_bytes long, removed array<int>, kept binary"


class Transform:
    """Burrows-Wheeler transform of some contexts, each closed by END: the byte before each suffix in
    sorted order, where that longer suffix stands, and the text position of each suffix."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        padded = np.concatenate((text, np.full(8, END, np.uint8)))
        head = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]).view(">u8").ravel()
        head = head.astype(np.uint64)
        order = np.argsort(head, kind="stable")
        rank, open_ = _ranks(order, head[order])
        depth = 8
        while open_.any() and depth < 128:           # prefix doubling among suffixes that are still alike
            own = order[open_]
            after = np.where(own + depth < n, rank[np.minimum(own + depth, n - 1)] + 1, 0)
            key = rank[own] * (n + 1) + after
            sub = np.argsort(key, kind="stable")
            place = np.flatnonzero(open_)
            order[place] = own[sub]
            key = key[sub]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            first = np.flatnonzero(new)
            rank[order[place]] = np.repeat(place[first], np.diff(np.append(first, len(key))))
            alone = new & np.append(new[1:], True)
            open_[place[alone]] = False
            depth *= 2
        self.position = order.astype(np.int32)
        self.head = head[order]
        at = np.empty(n, np.int32)
        at[order] = np.arange(n, dtype=np.int32)
        self.before = text[order - 1]
        self.before[order == 0] = END
        self.longer = at[order - 1]


def _ranks(order: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each position (that of the first of its equals), and which sorted places have equals."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    rank = np.empty(len(key), np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, len(key))))
    return rank, ~(new & np.append(new[1:], True))


def repeated_intervals(shards: list[Transform], left: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of the merged transform whose suffixes share `length` bytes: members (numbered through all
    shards in their sorted order) and the start of each interval. `left`: bytes up to the context's end.

    The interleaving of the shards is refined byte by byte: at depth d the suffixes stand in blocks of a
    common prefix of d bytes; read in that order, the bytes before them, sorted stably, give the blocks of
    depth d + 1. A block of one suffix has found its place and its longer suffixes are alone as well, so only
    the others are carried on; no suffix is compared with another or sorted anew.
    """
    base = np.cumsum([0] + [len(s.position) for s in shards])
    before = np.concatenate([s.before for s in shards])
    longer = np.concatenate([s.longer + np.int32(b) for s, b in zip(shards, base)])
    head = np.concatenate([s.head for s in shards])
    room = np.concatenate([x[s.position] for s, x in zip(shards, left)])
    member = np.flatnonzero(room >= 8).astype(np.int32)
    member = member[np.argsort(head[member], kind="stable")]      # sorted runs, merged by their first 8 bytes
    new = np.ones(len(member), bool)
    new[1:] = head[member[1:]] != head[member[:-1]]
    for _ in range(8, length):
        member, block = _crowded(member, new)
        symbol = before[member]
        inside = symbol != END
        member, block, symbol = longer[member[inside]], block[inside], symbol[inside]
        order = np.argsort(symbol, kind="stable")
        member, block, symbol = member[order], block[order], symbol[order]
        new = np.ones(len(member), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
    member, block = _crowded(member, new)
    starts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.empty(0, np.int64)
    return member, starts


def _crowded(member: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of blocks of several, and their block numbers."""
    several = ~(new & np.append(new[1:], True)) if len(new) else new
    return member[several], np.cumsum(new)[several].astype(np.int32)


def first_documents(texts: np.ndarray, lengths: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For every window of every context, context by context: the smallest document of an equal window."""
    closed = np.full(len(texts) + len(lengths), END, np.uint8)
    starts = np.cumsum(lengths + 1) - lengths - 1
    closed[np.arange(len(texts)) + np.repeat(np.arange(len(lengths)), lengths)] = texts
    context = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 1)
    left = ((starts + lengths).astype(np.int32)[context] - np.arange(len(closed), dtype=np.int32))
    windows = lengths - length + 1
    offset = np.cumsum(windows) - windows
    found = np.repeat(doc, windows)
    cuts = [0]
    while cuts[-1] < len(lengths):                   # whole contexts up to about SHARD_BYTES
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(starts, starts[cuts[-1]] + SHARD_BYTES))))
    spans = [(int(starts[a]), int(starts[b]) if b < len(starts) else len(closed)) for a, b in zip(cuts, cuts[1:])]
    shards = [Transform(closed[a:b]) for a, b in spans]
    member, first = repeated_intervals(shards, [left[a:b] for a, b in spans], length)
    if len(member):
        position = np.concatenate([s.position + a for s, (a, _) in zip(shards, spans)])[member]
        owner = context[position]
        least = np.minimum.reduceat(doc[owner], first)
        found[offset[owner] + position - starts[owner]] = np.repeat(least, np.diff(np.append(first, len(member))))
    return found


class Contexts:
    """Windows of a piece grouped by the gram that tells them: first and last window of each group."""

    def __init__(self, piece: Piece, length: int, width: int):
        self.buf, self.bounds = string_buffer(piece.text)
        ids = piece.ids()
        sums = running(_BYTE[self.buf])
        value = run_hash(_BYTE[self.buf], length - width + 1)
        # upper half of the hash, then the place: the smallest is the gram, the leftmost among equals
        place = np.uint64(0xFFFFFFFF)
        least = (value & ~place) | np.arange(len(value), dtype=np.uint64)
        step = 1
        while step < width and len(least) > step:    # of 2, 4, ... grams
            least = np.minimum(least[step:], least[:-step])
            step *= 2
        at = (least & place).astype(np.int64)
        sizes = np.diff(self.bounds)
        n = max(0, len(self.buf) - length + 1)
        whole = within(sizes, length)[:n]
        document = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[:n]
        start = np.flatnonzero(whole & (document < len(ids)))
        at = at[start] if n else at[:0]
        gram = value[at]
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
        opens = np.flatnonzero(new)
        self.first = start[opens]
        self.last = start[np.append(opens[1:], len(start)) - 1] if len(start) else start
        # mixed once more, as the smallest of many hashes would crowd the first shards and buckets
        self.gram = mix(gram[opens])
        self.doc = document[self.first]
        self.doc_id = ids[self.doc]
        self.ends = self.last + length
        self.content = span_hash(sums, self.first, self.ends)

    def chosen(self, elsewhere: np.ndarray) -> np.ndarray:
        """Contexts whose gram another document has."""
        own, span = exchange.shared_inside(self.gram, self.doc_id)
        table = own[exchange.member(own, elsewhere) | (span[:, 1] > span[:, 0])]
        return np.flatnonzero(exchange.member(self.gram, table))

    def distinct(self, elsewhere: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chosen contexts; those of them that come first among equal ones, by bucket; and each one's first."""
        chosen = self.chosen(elsewhere)
        _, first, which = np.unique(self.content[chosen], return_index=True, return_inverse=True)
        heads = chosen[first]
        order = np.lexsort((heads, exchange.shard_of(self.gram[heads], buckets)))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return chosen, heads[order], place[which]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one behind another."""
    total = np.cumsum(lengths)
    return np.repeat(starts - (total - lengths), lengths) + np.arange(total[-1] if len(total) else 0)


def _sent(piece: Piece, found: Contexts, elsewhere: np.ndarray, buckets: int) -> Iterator[tuple]:
    _, heads, _ = found.distinct(elsewhere, buckets)
    bounds = np.searchsorted(exchange.shard_of(found.gram[heads], buckets), np.arange(buckets + 1))
    for bucket in np.flatnonzero(np.diff(bounds)).tolist():
        own = heads[bounds[bucket]:bounds[bucket + 1]]
        sizes = found.ends[own] - found.first[own]
        yield (bucket, piece.part, piece.piece, len(own),
               pack(found.buf[ranges(found.first[own], sizes)], sizes.astype("<i4"), found.doc_id[own].astype("<i8")))


def _judged(length: int):
    def judge(table: pa.Table) -> pa.Table:
        # equal contexts are indexed once: only new ones are kept as the pieces' rows are opened
        number: dict[int, int] = {}
        texts, heads, which, sizes, doc = [], [], [], [], []
        for row in table.column("contexts"):
            text, size, own = unpack(row.as_py(), np.uint8, "<i4", "<i8")
            size = size.astype(np.int64)
            ends = np.cumsum(size)
            content = span_hash(running(_BYTE[text]), ends - size, ends).tolist()
            known = len(number)
            which.append(np.array([number.setdefault(c, len(number)) for c in content], np.int64))
            new = np.flatnonzero(which[-1] >= known)
            new = new[np.unique(which[-1][new], return_index=True)[1]]
            texts.append(text[ranges(ends[new] - size[new], size[new])])
            heads.append(size[new])
            sizes.append(size)
            doc.append(own)
        heads = np.concatenate(heads)
        first = np.full(len(heads), np.iinfo(np.int64).max)
        np.minimum.at(first, np.concatenate(which), np.concatenate(doc))
        least = first_documents(np.concatenate(texts), heads, first, length)
        offset = np.cumsum(heads - length + 1) - (heads - length + 1)
        bits = [least[ranges(offset[k], n - length + 1)] < np.repeat(d, n - length + 1)
                for k, n, d in zip(which, sizes, doc)]
        return pa.table({"part": table.column("part"), "piece": table.column("piece"),
                         "shard": table.column("bucket"), "n": pa.array([len(b) for b in bits], pa.int64()),
                         "bits": pa.array([pack(np.packbits(b)) for b in bits], pa.binary())})
    return judge


def _cut(piece: Piece, found: Contexts, elsewhere: np.ndarray, bits: dict[int, np.ndarray], buckets: int,
         length: int) -> pa.Table:
    chosen, heads, head = found.distinct(elsewhere, buckets)
    windows = found.last - found.first + 1
    flags = np.concatenate([bits[k] for k in sorted(bits)]) if bits else np.zeros(0, bool)
    offset = np.cumsum(windows[heads]) - windows[heads]
    n = windows[chosen]
    later = flags[ranges(offset[head], n)] if len(chosen) else flags
    later = later | np.repeat(found.doc_id[chosen] > found.doc_id[heads[head]], n)
    gone = covered(ranges(found.first[chosen], n)[later], length, len(found.buf))
    sizes = np.diff(found.bounds)
    document = np.repeat(np.arange(len(sizes)), sizes)
    first, last = run_bounds(gone, found.bounds)
    spans: list[list[int]] = [[] for _ in range(len(sizes))]
    for a, b, d in zip(first.tolist(), last.tolist(), document[first].tolist()):
        spans[d] += [a - int(found.bounds[d]), b - int(found.bounds[d])]
    left = np.concatenate(([0], np.cumsum(~gone)))[found.bounds]
    kept = pa.Array.from_buffers(pa.large_binary(), len(sizes), [
        None, pa.py_buffer(left.astype("<i8").tobytes()), pa.py_buffer(found.buf[~gone].tobytes())])
    return pa.table({"doc_id": piece.doc_id, "n_bytes": pa.array(sizes, pa.int64()),
                     "removed": pa.array(spans, pa.list_(pa.int32())), "kept": kept.cast(pa.binary())})


def repeated_strings(docs: DataFrame, length: int = LENGTH, width: int = WIDTH) -> DataFrame:
    """Per document row: doc_id, n_bytes, removed (flat start, end pairs in bytes) and the kept bytes.

    A byte goes when a string of `length` bytes that covers it also starts in a document with a smaller id;
    strings are judged on the texts as they came and never cross documents.

    NULL and empty texts have no bytes; rows without a doc_id lose nothing and are no earlier document; rows
    that repeat a doc_id don't make each other lose anything and each give a row; other columns are ignored;
    an empty table gives an empty result.
    """
    found = exchange.parts(docs, piece_bytes=PIECE_BYTES)
    table = found.table.select("part", "piece", "blob")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in exchange.pieces_of(batch):
                yield pa.RecordBatch.from_arrays([pa.array([len(string_buffer(piece.text)[0])])], ["n"])

    total = table.mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
    shards = exchange.shard_count(total * 2 // (width + 1))
    buckets = max(1, -(-total // BUCKET_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for piece in exchange.pieces_of(batch):
                    own = Contexts(piece, length, width)
                    yield from exchange.entries(piece, own.gram, own.doc, shards)
        yield from exchange.entry_batches(rows())

    def contexts(pieces: Iterator[Piece], answers: pa.Table) -> pa.Table:
        known, rows = Answers(answers), []
        for piece in pieces:
            own = Contexts(piece, length, width)
            rows += _sent(piece, own, known.flagged(piece, own.gram, shards), buckets)
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        names = [c.split()[0] for c in CONTEXTS.split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=names)

    def cut(pieces: Iterator[Piece], answers: pa.Table) -> pa.Table:
        of_grams = answers.filter(pa.compute.equal(answers.column("kind"), 0))
        of_contexts = answers.filter(pa.compute.equal(answers.column("kind"), 1))
        grams, judged = Answers(of_grams), Answers(of_contexts)
        done = []
        for piece in pieces:
            own = Contexts(piece, length, width)
            done.append(_cut(piece, own, grams.flagged(piece, own.gram, shards),
                             judged.of.get((piece.part, piece.piece), {}), buckets, length))
        return pa.concat_tables(done) if done else pa.table(
            {"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()),
             "removed": pa.array([], pa.list_(pa.int32())), "kept": pa.array([], pa.binary())})

    grams = written(exchange.recurring(table.mapInArrow(send, exchange.ENTRIES), later=False), "grams")
    judged = written(exchange.with_answers(found, grams, contexts, CONTEXTS)
                     .groupBy("bucket").applyInArrow(_judged(length), ANSWERS), "judged")
    both = grams.withColumn("kind", F.lit(0)).unionByName(judged.withColumn("kind", F.lit(1)))
    return exchange.with_answers(found, both, cut, RESULT)


def contract(found: DataFrame) -> DataFrame:
    """The digest columns of `op3_suffix_dedup`."""
    gone = F.aggregate("removed", F.lit(0), lambda total, bound: bound - total)
    return found.select("doc_id", "n_bytes", gone.cast("long").alias("n_removed"),
                        (F.size("removed") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
