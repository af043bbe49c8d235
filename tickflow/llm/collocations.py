"""Collocations of two to four words: phrase counts in a HAT-trie, scores and ranks as Spark jobs.

A task counts phrases in a trie over word ids whose leaves are hash containers. A container that grows too
large bursts into one container per next word; when the trie holds too many phrases, whole subtrees leave it
as sorted runs. The runs meet by the first two words of their phrases and are summed there.

Only phrases that may be frequent are counted: each pass over the texts counts the phrases of one length and
sends short keys of those one word longer, whose summed counts are never below the true ones. A phrase can
only be frequent where its two parts one word shorter are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickflow.llm.words import (LOWER, Words, byte_sums, byte_table, mix, return_memory, slices, span_hash,
                                string_buffer)
from tickflow.runtime import BROADCAST_ROWS, stored_bytes, written

LEAST = 30                # occurrences of a candidate
LONGEST = 4               # words of a candidate
TOP = 2000                # phrases reported for a language
COVERED = 80              # percent of its occurrences from which a phrase counts as part of a longer one
BURST = 4096              # phrases in a container before it bursts
HELD = 1 << 19            # phrases in the trie of a task before subtrees are spilled
KEYS_HELD = 1 << 21       # short keys of a task before they are sent
MARK_BITS = 1 << 27       # marks of frequent phrases that are sent to the tasks: 16 MB at any size
MARK_BLOCKS = 256
PART_BYTES = 8 << 20      # text whose phrases meet in one group, so that a group is of one size at any scale
KEY_BITS = 24             # of the short keys within a group
FEW_BYTES = 16 << 20      # lookup tables up to this size are broadcast
_ID = 8                   # bytes of a word id

_IS_BREAK = byte_table(lambda b: b in b".,;:!?" or 0x0A <= b <= 0x0D)
_IS_WORD = byte_table(lambda b: b not in b".,;:!? \t" and not 0x0A <= b <= 0x0D)
_STEP = np.uint64(0x9E3779B97F4A7C15)

IDS = [f"w{k + 1}" for k in range(LONGEST)]
RUN = "part int, keys binary, run binary, w1 long, c long, lang string, word string"
_RUN = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("run", pa.binary()), ("w1", pa.int64()), ("c", pa.int64()),
                  ("lang", pa.string()), ("word", pa.string())])
SUMMED = "places binary, " + ", ".join(f"{w} long" for w in IDS) + ", f long, lang string, word string"
_SUMMED = pa.schema([("places", pa.binary())] + [(w, pa.int64()) for w in IDS]
                    + [("f", pa.int64()), ("lang", pa.string()), ("word", pa.string())])


class HatTrie:
    """Counts of word-id sequences of one length: hash containers below a shallow trie of word ids.

    An inner node is a dict from a word id (8 bytes) to its subtree, a container a dict from the rest of a
    sequence to its count. Containers of single words have no further word to burst by and stay whole.
    """

    class Inner(dict):
        __slots__ = ()

    def __init__(self, words: int, burst: int = BURST, held: int = HELD):
        self.words, self.burst, self.held = words, burst, held
        self.root: dict = {}
        self.size = 0

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Add distinct sequences, one a row, with their counts."""
        order = np.argsort(ids[:, 0], kind="stable")
        keys = np.ascontiguousarray(ids[order].astype(">u8"))
        self.root = self._add(self.root, keys, counts[order].tolist())

    def _add(self, node: dict, keys: np.ndarray, counts: list[int]) -> dict:
        width = keys.shape[1]
        if isinstance(node, self.Inner):
            heads = keys[:, 0]
            cuts = np.flatnonzero(heads[1:] != heads[:-1]) + 1
            starts = [0, *cuts.tolist()]
            ends = [*cuts.tolist(), len(keys)]
            names = heads[starts].view(f"V{_ID}").tolist()
            for name, a, b in zip(names, starts, ends):
                node[name] = self._add(node.get(name) or {}, keys[a:b, 1:], counts[a:b])
            return node
        before = len(node)
        rest = np.ascontiguousarray(keys).view(f"V{_ID * width}").ravel().tolist()
        for key, count in zip(rest, counts):
            node[key] = node.get(key, 0) + count
        self.size += len(node) - before
        return self._burst(node, width) if len(node) > self.burst and width > 1 else node

    def _burst(self, container: dict, width: int) -> dict:
        inner = self.Inner()
        for key, count in container.items():
            inner.setdefault(key[:_ID], {})[key[_ID:]] = count
        for name, child in inner.items():
            if len(child) > self.burst and width > 2:
                inner[name] = self._burst(child, width - 1)
        return inner

    def _entries(self, node: dict, head: bytes) -> Iterator[tuple[bytes, int]]:
        for key, child in node.items():
            if isinstance(node, self.Inner):
                yield from self._entries(child, head + key)
            else:
                yield head + key, child

    def _run(self, node: dict, head: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """A subtree as a sorted run."""
        entries = list(self._entries(node, head))
        ids = np.frombuffer(b"".join(e[0] for e in entries), ">u8").reshape(-1, self.words).astype(np.uint64)
        counts = np.array([e[1] for e in entries], np.int64)
        order = np.lexsort(ids.T[::-1])
        return ids[order], counts[order]

    def spill(self, everything: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sorted runs of the largest subtrees, until half of the room is free, or of the whole trie."""
        if everything or not isinstance(self.root, self.Inner):
            if self.size:
                yield self._run(self.root)
            self.root, self.size = {}, 0
            return
        sizes = {name: sum(1 for _ in self._entries(child, b"")) for name, child in self.root.items()}
        leaving = self.Inner()
        for name in sorted(sizes, key=lambda n: (-sizes[n], n)):
            if self.size <= self.held // 2:
                break
            leaving[name] = self.root.pop(name)
            self.size -= sizes[name]
        yield self._run(leaving)


def chained(ids: list[np.ndarray]) -> np.ndarray:
    """Hash of the sequences with the given ids at their first, second, ... place."""
    found = ids[0]
    for further in ids[1:]:
        found = mix(found * _STEP + further)
    return found


class Phrases:
    """Word ids of a batch and, for every place, whether a phrase of n words from here stays in its piece.

    The id of a word is a hash of its language and itself, so phrases of two languages never meet.
    """

    def __init__(self, batch: pa.RecordBatch):
        buf, bounds = string_buffer(batch.column("text"))
        self.buf = LOWER[buf]
        self.words = Words(self.buf, bounds, _IS_WORD)
        self.langs = pc.fill_null(batch.column("lang").cast(pa.string()), "und").dictionary_encode()
        names, places = string_buffer(self.langs.dictionary)
        seeds = span_hash(byte_sums(names), places[:-1], places[1:])
        self.lang = self.langs.indices.to_numpy()[self.words.document()] if len(self.words.starts) else np.empty(0, int)
        self.ids = mix(self.words.hashes() + seeds[self.lang] * _STEP)
        breaks = np.cumsum(_IS_BREAK[self.buf])
        self.piece = breaks[self.words.starts] + self.words.document() if len(self.words.starts) else np.empty(0, int)

    def inside(self, n: int) -> np.ndarray:
        """Whether a phrase of n words fits into the piece, for each place where one could begin."""
        places = len(self.ids) - n + 1
        return self.piece[n - 1:] == self.piece[:places] if places > 0 else np.empty(0, bool)

    def whole(self, n: int) -> np.ndarray:
        """Hash of the n words from each place."""
        places = max(len(self.ids) - n + 1, 0)
        return chained([self.ids[k:places + k] for k in range(n)])

    def text(self, place: int) -> str:
        return self.buf[self.words.starts[place]:self.words.ends[place]].tobytes().decode("utf-8", "replace")


def short_key(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Group of a phrase above its short key there."""
    return ((hashes >> np.uint64(KEY_BITS)) % np.uint64(parts) << np.uint64(KEY_BITS)) | (hashes & np.uint64((1 << KEY_BITS) - 1))


def mark_place(keys: np.ndarray) -> np.ndarray:
    return mix(keys + _STEP) & np.uint64(MARK_BITS - 1)


def marked(marks: np.ndarray, hashes: np.ndarray, parts: int) -> np.ndarray:
    bit = mark_place(short_key(hashes, parts))
    return (marks[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def packed_keys(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising short keys of one group as differences, with their counts, in as few bytes as they need."""
    gaps = np.diff(keys, prepend=keys[:1] * 0)
    sizes = [max(1, (int(v.max()).bit_length() + 7) // 8) for v in (gaps, counts)]
    columns = [v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes() for v, n in zip((gaps, counts), sizes)]
    return np.array([len(keys), *sizes], "<u4").tobytes() + b"".join(columns)


def unpacked_keys(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, *sizes = np.frombuffer(raw, "<u4", 3).tolist()
    at, out = 12, []
    for size in sizes:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :size] = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T
        out.append(wide.view("<u8").ravel().astype(np.int64))
        at += n * size
    return np.cumsum(out[0]), out[1]


class Keys:
    """Short keys of the phrases of a task and their counts."""

    def __init__(self, parts: int, held: int = KEYS_HELD):
        self.parts, self.held = parts, held
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, hashes: np.ndarray) -> bool:
        """Take in a batch; whether there are now so many that they should be sent."""
        if len(hashes):
            self.found.append(np.unique(short_key(hashes, self.parts), return_counts=True))
        if sum(len(k) for k, _ in self.found) > self.held:
            self._merge()
        return sum(len(k) for k, _ in self.found) > self.held // 2

    def _merge(self) -> None:
        keys = np.concatenate([k for k, _ in self.found])
        counts = np.concatenate([c for _, c in self.found])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        self.found = [(keys[starts], np.add.reduceat(counts[order], starts))]

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.found:
            return
        self._merge()
        (keys, counts), self.found = self.found[0], []
        part = (keys >> np.uint64(KEY_BITS)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        low = (keys & np.uint64((1 << KEY_BITS) - 1)).astype(np.int64)
        rows = [packed_keys(low[a:b], counts[a:b]) for a, b in zip(cuts, [*cuts[1:], len(keys)])]
        yield _sent(part[cuts], keys=rows)


def _sent(part: np.ndarray, **columns) -> pa.RecordBatch:
    """Rows of RUN with the given columns."""
    columns["part"] = part.astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(part), f.type)
                                       for f in _RUN], schema=_RUN)


def part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    """Group in which the phrases with the same first two words meet."""
    return (mix(chained([ids[:, k] for k in range(min(2, ids.shape[1]))]) + np.uint64(1)) % np.uint64(parts)).astype(np.int32)


def packed_run(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run: its distinct word ids, and for each phrase their places among them and its count, all in as few
    bytes as they need."""
    words, place = np.unique(ids, return_inverse=True)
    place = place.reshape(ids.shape).T
    kinds = [np.min_scalar_type(len(words)), np.min_scalar_type(int(counts.max()))]
    head = np.array([len(words), len(counts), ids.shape[1], kinds[0].itemsize, kinds[1].itemsize], "<i8")
    return b"".join([head.tobytes(), words.astype("<u8").tobytes(), place.astype(kinds[0]).tobytes(), counts.astype(kinds[1]).tobytes()])


def unpacked_run(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    words, phrases, width, a, b = np.frombuffer(raw, "<i8", 5).tolist()
    ids = np.frombuffer(raw, "<u8", words, 40)
    at = 40 + 8 * words
    place = np.frombuffer(raw, f"<u{a}", phrases * width, at).reshape(width, phrases)
    return ids[place].T, np.frombuffer(raw, f"<u{b}", phrases, at + a * phrases * width).astype(np.int64)


def _rows(ids: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """A run cut by the groups in which its phrases meet."""
    part = part_of(ids, parts)
    order = np.argsort(part, kind="stable")
    names, starts = np.unique(part[order], return_index=True)
    cuts = [order[a:b] for a, b in zip(starts, [*starts[1:], len(order)])]
    return _sent(names, run=[packed_run(ids[own], counts[own]) for own in cuts])


def _summed(least: int):
    """Group of keys and runs: places of the marks of keys that occur so often, phrases that do, and of named rows
    the sum of each language and one text for each word."""
    def merge(table: pa.Table) -> pa.Table:
        out = []

        def give(n: int, **columns) -> None:
            out.append(pa.Table.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _SUMMED],
                                            schema=_SUMMED))

        keys = [unpacked_keys(k) for k in table.column("keys").drop_null().to_pylist()]
        if keys:
            low, place = np.unique(np.concatenate([k for k, _ in keys]), return_inverse=True)
            total = np.bincount(place, np.concatenate([c for _, c in keys]))
            part = table.column("part")[0].as_py()
            often = low[total >= least].astype(np.uint64) | np.uint64(part << KEY_BITS)
            give(1, places=pa.array([mark_place(often).astype("<u4").tobytes()], pa.binary()))
        runs = [unpacked_run(r) for r in table.column("run").drop_null().to_pylist()]
        if runs:
            ids, counts = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
            whole = chained([ids[:, k] for k in range(ids.shape[1])])
            order = np.argsort(whole, kind="stable")
            starts = np.flatnonzero(np.concatenate(([True], np.diff(whole[order]) != 0)))
            total = np.add.reduceat(counts[order], starts)
            keep = total >= least
            found = ids[order[starts[keep]]]
            give(len(found), f=pa.array(total[keep]), **{IDS[k]: pa.array(np.ascontiguousarray(found[:, k]).view(np.int64))
                                                         for k in range(found.shape[1])})
        named = table.filter(pc.is_valid(table.column("lang")))
        if named.num_rows:
            by = named.select(["w1", "lang", "word", "c"]).group_by(["w1", "lang", "word"]).aggregate([("c", "sum")])
            give(by.num_rows, w1=by.column("w1"), f=by.column("c_sum"), lang=by.column("lang"), word=by.column("word"))
        return pa.concat_tables(out) if out else _SUMMED.empty_table()
    return merge


def _counter(n: int, shared, parts: int, burst: int, held: int):
    """Task of one pass: sorted runs of the marked phrases of n words and short keys of the phrases of n + 1 words.
    Before any marks (n = 0) also the words of each language, with n = 1 the texts of the marked words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = None if shared is None else shared.value
        trie, keys, totals, known = HatTrie(max(n, 1), burst, held), Keys(parts), {}, set()
        for batch in slices(batches):
            phrases = Phrases(batch)
            if n == 0:
                names = phrases.langs.dictionary.to_pylist()
                for code, k in enumerate(np.bincount(phrases.lang, minlength=len(names)).tolist()):
                    totals[names[code]] = totals.get(names[code], 0) + k
                longer = phrases.ids
            else:
                whole = phrases.whole(n)
                frequent = phrases.inside(n)
                frequent[frequent] = marked(marks, whole[frequent], parts)
                at = np.flatnonzero(frequent)
                if len(at):
                    _, first, counts = np.unique(whole[at], return_index=True, return_counts=True)
                    trie.add(np.stack([phrases.ids[at[first] + k] for k in range(n)], 1), counts)
                if n == 1:
                    yield from _texts(phrases, at, known, parts)
                    if len(known) > held:
                        known.clear()
                if trie.size > held:
                    for run in trie.spill():
                        yield _rows(*run, parts)
                at = np.flatnonzero(phrases.inside(n + 1) & frequent[:-1] & frequent[1:]) if n < LONGEST else np.empty(0, int)
                longer = chained([phrases.ids[at + k] for k in range(n + 1)]) if len(at) else np.empty(0, np.uint64)
            if keys.add(longer):
                yield from keys.send()
        yield from keys.send()
        for run in trie.spill(everything=True):
            yield _rows(*run, parts)
        if totals:
            names = sorted(totals)
            yield _sent(np.array([zlib.crc32(name.encode()) % parts for name in names]), c=[totals[k] for k in names], lang=names)
        del trie, keys
        return_memory()
    return count


def _texts(phrases: Phrases, at: np.ndarray, known: set, parts: int) -> Iterator[pa.RecordBatch]:
    """The words at the given places, each once for a task."""
    ids, first = np.unique(phrases.ids[at], return_index=True)
    new = [(i, p) for i, p in zip(ids.tolist(), at[first].tolist()) if i not in known]
    if new:
        known.update(i for i, _ in new)
        own = np.array([i for i, _ in new], np.uint64)
        langs = phrases.langs.dictionary.take(pa.array(phrases.lang[[p for _, p in new]]))
        yield _sent(part_of(own[:, None], parts), w1=own.view(np.int64), c=np.zeros(len(own), np.int64), lang=langs,
                    word=[phrases.text(p) for _, p in new])


def _marks(summed: DataFrame) -> np.ndarray:
    """One bit for each key that occurs often enough, at a place given by its hash; a table of fixed size.

    A place that a rare phrase shares with a frequent one only means that some phrases are counted in vain.
    """
    each = MARK_BITS // MARK_BLOCKS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("places").to_pylist():
                bit = np.unique(np.frombuffer(raw, "<u4")).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((bit // each).astype(np.int32)),
                                                  pa.array((bit % each).astype(np.int32))], ["block", "bit"])

    def pack(table: pa.Table) -> pa.Table:
        bits = np.zeros(each, np.uint8)
        bits[table.column("bit").to_numpy()] = 1
        return pa.table({"block": table.column("block").slice(0, 1),
                         "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    rows = (summed.where("places is not null").select("places").mapInArrow(place, "block int, bit int")
            .groupBy("block").applyInArrow(pack, "block int, bits binary").collect())
    out = np.zeros(MARK_BITS // 8, np.uint8)
    for r in rows:
        out[r["block"] * each // 8:(r["block"] + 1) * each // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _few(stored: DataFrame) -> bool:
    """Whether a written table has few enough rows and bytes to be broadcast."""
    return stored_bytes(stored) <= FEW_BYTES and stored.count() <= BROADCAST_ROWS


def phrase_counts(docs: DataFrame, least: int = LEAST, burst: int = BURST,
                  held: int = HELD) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Written tables of the phrases of 1 to 4 words that occur at least so often (w1.., f), the texts of their
    words (w1, lang, word), and the words of each language (lang, n).

    Pieces end at ``.,;:!?``, line breaks and the ends of texts; words are what blanks and tabs leave of them,
    with A-Z in lower case. NULL texts are empty, a NULL lang is ``und``; other columns are ignored, and rows
    without or with repeated ids count like any other. An empty table gives empty tables.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("text").cast("string"), F.col("lang").cast("string"))
    tables, texts, totals, shared = [], None, None, None
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + size // PART_BYTES
    for n in range(LONGEST + 1):
        runs = source.mapInArrow(_counter(n, shared, parts, burst, held), RUN)
        summed = written(runs.groupBy("part").applyInArrow(_summed(least), SUMMED), f"phrases{n}")
        if shared is not None:
            shared.unpersist()
        if n == 0:
            totals = written(summed.where("lang is not null").select("lang", F.col("f").alias("n")), "totals")
        else:
            tables.append(written(summed.where("lang is null and places is null").select(*IDS[:n], "f"), f"frequent{n}"))
        if n == 1:
            texts = written(summed.where("word is not null").select("w1", "lang", "word").join(
                tables[0].select("w1"), "w1", "left_semi"), "words")
        if n < LONGEST:
            shared = spark.sparkContext.broadcast(_marks(summed))
    return tables, texts, totals


def _score(a: str, left: str, right: str) -> F.Column:
    """floor(2000000 a / (l + r)) in decimals, as products may pass 64 bits."""
    return F.expr(f"(cast({a} as decimal(20, 0)) * 2000000) div "
                  f"(cast({left} as decimal(20, 0)) + cast({right} as decimal(20, 0)))")


def _scored(candidates: DataFrame, lookups: list[DataFrame], n: int) -> DataFrame:
    """Candidates of n words with their lowest-scoring cut; both parts of a candidate are frequent."""
    out = candidates.withColumnRenamed("f", "a")
    for k in range(1, n):
        for part, side in ((IDS[:k], "l"), (IDS[k:n], "r")):
            lookup = lookups[len(part) - 1].select(
                *[F.col(own).alias(name) for own, name in zip(IDS, part)], F.col("f").alias(f"{side}{k}"))
            out = out.join(lookup, part)
    cuts = [F.struct(_score("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"),
                     F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, n)]
    best = F.array_min(F.array(*cuts))
    empty = [F.lit(None).cast("long").alias(w) for w in IDS[n:]]
    return out.select(*IDS[:n], *empty, "a", best.alias("cut")).select(*IDS, "a", "cut.l", "cut.r", "cut.score")


def _uncovered(tables: list[DataFrame], n: int, covered: int) -> DataFrame:
    """Candidates of n words that no longer candidate holds in nearly all of their occurrences."""
    own = tables[n - 1]
    if n == LONGEST:
        return own
    longer = None
    for m in range(n + 1, LONGEST + 1):
        for at in range(m - n + 1):
            part = tables[m - 1].select(*[F.col(IDS[at + j]).alias(IDS[j]) for j in range(n)], F.col("f").alias("over"))
            longer = part if longer is None else longer.unionByName(part)
    longest = longer.groupBy(*IDS[:n]).agg(F.max("over").alias("over"))
    inside = F.expr(f"cast(over as decimal(20, 0)) * 100 >= cast(f as decimal(20, 0)) * {covered}")
    return own.join(longest, IDS[:n], "left").where(~F.coalesce(inside, F.lit(False))).select(*IDS[:n], "f")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED,
                 burst: int = BURST, held: int = HELD) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Candidates are phrases of 2 to 4 words that occur `least` times; each has the score of its weakest cut,
    2,000,000 a / (l + r) rounded down. Phrases that a longer candidate covers in `covered` percent of their
    occurrences go. The first `top` of a language by score, occurrences and bytes are returned. Reading of
    texts and of NULL, empty and repeated rows as in `phrase_counts`; without candidates the result is empty.
    """
    tables, texts, totals = phrase_counts(docs, least, burst, held)
    lookups = [F.broadcast(t) if _few(t) else t for t in tables[:-1]]
    found = None
    for n in range(2, LONGEST + 1):
        part = _scored(_uncovered(tables, n, covered), lookups, n)
        found = part if found is None else found.unionByName(part)
    words = F.broadcast(texts) if _few(texts) else texts
    first = words.select("w1", "lang", F.col("word").alias("word1"))
    order = (F.desc("score"), F.desc("a"))
    # all that tie with the last place stay until their texts are known
    best = (found.join(first, "w1").withColumn("place", F.rank().over(W.partitionBy("lang").orderBy(*order)))
            .where(F.col("place") <= top))
    best = written(best, "best")
    for k in range(2, LONGEST + 1):
        best = best.join(words.select(F.col("w1").alias(f"w{k}"), F.col("word").alias(f"word{k}")), f"w{k}", "left")
    phrase = F.concat_ws(" ", *[f"word{k + 1}" for k in range(LONGEST)])
    ranked = best.withColumn("phrase", phrase).withColumn(
        "rank", F.row_number().over(W.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).where(
        F.col("rank") <= top)
    return ranked.join(F.broadcast(totals) if _few(totals) else totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
