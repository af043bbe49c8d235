"""Passages of words that an earlier document has, located by Aho-Corasick automata over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.llm import exchange
from tickflow.llm.exchange import Answers, Piece
from tickflow.llm.words import NOT_SPACE, Words, covered, run_bounds, run_hash, string_buffer, within
from tickflow.runtime import written

WINDOW = 13
AUTOMATON_BLOCKS = 100_000        # blocks compiled into one automaton
LETTERS = 128
RESULT = "doc_id long, n_words long, n_removed long, removed array<int>, kept string"


class PieceWords:
    """Words of a piece and the windows of its documents that have an id."""

    def __init__(self, piece: Piece, window: int):
        self.window = window
        self.words = Words(*string_buffer(piece.text), NOT_SPACE)
        self.hashes = self.words.hashes()
        grams = run_hash(self.hashes, window)
        document = self.words.document()
        ids = piece.ids()
        whole = within(self.words.counts, window)[:len(grams)] & (document[:len(grams)] < len(ids))
        self.at = np.flatnonzero(whole)
        self.grams, self.doc = grams[self.at], document[self.at]
        self.doc_id = ids[self.doc]


@dataclass
class Phrases:
    """Recurring windows of a piece: whether one starts at a word, and from which document on it counts (every
    one where an earlier document elsewhere has the window, else those after its first here); and the runs of
    places that hold the first occurrence of each."""

    wanted: np.ndarray
    least: np.ndarray
    first: np.ndarray
    last: np.ndarray


def phrases(found: PieceWords, elsewhere: np.ndarray) -> Phrases:
    own, span = exchange.shared_inside(found.grams, found.doc_id)
    outside = exchange.member(own, elsewhere)
    chosen = outside | (span[:, 1] > span[:, 0])
    which = np.searchsorted(own, found.grams)
    n = len(found.words.starts)
    wanted, least = np.zeros(n, bool), np.zeros(n, np.int64)
    wanted[found.at] = chosen[which]
    least[found.at] = np.where(outside, np.iinfo(np.int64).min, span[:, 0])[which] if len(own) else 0
    _, first = np.unique(found.grams, return_index=True)
    heads = np.zeros(n, bool)
    heads[found.at[first[chosen]]] = True
    return Phrases(wanted, least, *run_bounds(heads, found.words.bounds))


class Stream:
    """The words of a piece as one string: a fixed number of letters for each, a break between documents.

    Letters of each place in a word come from a range of their own, so a match cannot begin inside a word, and
    a node of an automaton has few children.
    """

    def __init__(self, numbers: np.ndarray, document: np.ndarray, documents: int):
        self.width = 1
        while LETTERS ** self.width <= (numbers.max() if len(numbers) else 0):
            self.width += 1
        self.offset = np.arange(len(numbers)) * self.width + document
        letters = np.full(len(numbers) * self.width + documents, ord("\n"), "<u4")
        rest = numbers.copy()
        for k in range(self.width):
            letters[self.offset + k] = 256 + k * LETTERS + rest % LETTERS
            rest //= LETTERS
        self.text = letters.tobytes().decode("utf-32-le")

    def run(self, place: int, words: int) -> str:
        at = self.offset[place]
        return self.text[at:at + words * self.width]


def locate(found: PieceWords, elsewhere: np.ndarray) -> np.ndarray:
    """Word places at which a window begins that an earlier document has.

    Runs of recurring windows are cut into blocks so short that each window holds a whole one. Automata of a
    bounded number of blocks are compiled and every document of the piece is streamed through them; each hit
    is extended word by word to the windows around it.
    """
    wanted = phrases(found, elsewhere)
    if not len(wanted.first):
        return np.empty(0, np.int64)
    window = found.window
    block = window // 2 + 1
    numbers, document = exact_numbers(found.words), found.words.document()
    stream = Stream(numbers, document, len(found.words.counts))
    sources: dict[str, list[int]] = {}
    step = window - block + 1                        # a window begins at most so many words before its block
    for a, b in zip(wanted.first.tolist(), (wanted.last - 1).tolist()):
        for place in [*range(a, b, step), b]:
            sources.setdefault(stream.run(place, block), []).append(place)
    doc_id = np.full(len(found.words.counts), np.iinfo(np.int64).min)
    doc_id[found.doc] = found.doc_id
    starts = [np.empty(0, np.int64)]
    keys = list(sources)
    for a in range(0, len(keys), AUTOMATON_BLOCKS):
        part = keys[a:a + AUTOMATON_BLOCKS]
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, key in enumerate(part):
            automaton.add_word(key, k)
        automaton.make_automaton()
        hits = np.array(list(automaton.iter(stream.text)), np.int64).reshape(-1, 2)
        here = np.searchsorted(stream.offset, hits[:, 0] - block * stream.width + 1)
        count = np.array([len(sources[key]) for key in part])
        there = np.concatenate([np.array(sources[key]) for key in part])
        begin = (np.cumsum(count) - count)[hits[:, 1]]
        n = count[hits[:, 1]]
        for lo, hi in _bounded(n):
            i = np.repeat(here[lo:hi], n[lo:hi])
            ends = np.cumsum(n[lo:hi])
            j = there[np.repeat(begin[lo:hi] - (ends - n[lo:hi]), n[lo:hi]) + np.arange(len(i))]
            starts.append(_extended(numbers, document, i, j, window, block, wanted, doc_id))
    return np.unique(np.concatenate(starts))


def _bounded(n: np.ndarray, most: int = 200_000) -> Iterator[tuple[int, int]]:
    """Ranges of hits with a bounded number of pairs in each (or a single hit)."""
    total, at = np.cumsum(n), 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def _extended(numbers, document, i, j, window, block, wanted: Phrases, doc_id) -> np.ndarray:
    """Starts of the windows around the blocks at i that equal wanted windows around the blocks at j."""
    reach = np.arange(block - window, window)
    p, q = i[:, None] + reach, j[:, None] + reach
    ok = (p >= 0) & (p < len(numbers)) & (q >= 0) & (q < len(numbers))
    p, q = np.clip(p, 0, len(numbers) - 1), np.clip(q, 0, len(numbers) - 1)
    ok &= (numbers[p] == numbers[q]) & (document[p] == document[i][:, None]) & (document[q] == document[j][:, None])
    out = []
    for k in range(window - block + 1):
        same = np.flatnonzero(ok[:, k:k + window].all(axis=1))
        at, like = i[same] + reach[k], j[same] + reach[k]
        out.append(at[wanted.wanted[like] & (doc_id[document[at]] > wanted.least[like])])
    return np.concatenate(out)


def exact_numbers(words: Words) -> np.ndarray:
    """Numbers of the words by their very bytes."""
    data = words.buf.tobytes()
    return pd.factorize(np.array([data[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist())], object))[0]


def _cut(piece: Piece, window: int, answers: Answers, shards: int) -> pa.Table:
    found = PieceWords(piece, window)
    words = found.words
    starts = locate(found, answers.flagged(piece, found.grams, shards))
    gone = covered(starts, window, len(words.starts))
    n_removed = np.add.reduceat(np.append(gone, False), np.minimum(words.bounds[:-1], len(gone))) * (words.counts > 0)
    data = words.buf.tobytes()
    first, last = run_bounds(gone, words.bounds)
    removed: list[list[int]] = [[] for _ in range(len(words.counts))]
    document = words.document()
    for a, b in zip(first.tolist(), last.tolist()):
        d = document[a]
        removed[d] += [a - int(words.bounds[d]), b - int(words.bounds[d])]
    kept = []
    keep = np.flatnonzero(~gone)
    cuts = np.searchsorted(keep, words.bounds)
    a, b = words.starts[keep].tolist(), words.ends[keep].tolist()
    for d in range(len(words.counts)):
        kept.append(b" ".join([data[s:e] for s, e in zip(a[cuts[d]:cuts[d + 1]], b[cuts[d]:cuts[d + 1]])]).decode())
    return pa.table({"doc_id": piece.doc_id, "n_words": pa.array(words.counts, pa.int64()),
                     "n_removed": pa.array(n_removed, pa.int64()),
                     "removed": pa.array(removed, pa.list_(pa.int32())), "kept": pa.array(kept, pa.string())})


def repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document row: doc_id, n_words, n_removed, removed (flat start, end pairs in words) and the kept text.

    A word goes when a window of `window` words that covers it also starts in a document with a smaller id;
    windows are judged on the texts as they came and never cross documents. Recurring windows are confirmed
    by an exchange of their hashes (see `exchange`), compiled from the piece's own words into automata, and
    located in all documents of the piece.

    NULL and empty texts have no words; words are runs of anything but ASCII white space and are kept joined
    by one blank; rows without a doc_id lose nothing and are no earlier document; rows that repeat a doc_id
    don't make each other lose anything and each give a row; other columns are ignored; an empty table gives
    an empty result.
    """
    found = exchange.parts(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in exchange.pieces_of(batch):
                words = Words(*string_buffer(piece.text), NOT_SPACE)
                yield pa.RecordBatch.from_arrays([pa.array([len(words.starts)])], ["n"])

    total = found.table.select("part", "piece", "blob").mapInArrow(count, "n long").agg(F.sum("n")).first()[0]
    shards = exchange.shard_count(total or 0)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for piece in exchange.pieces_of(batch):
                    own = PieceWords(piece, window)
                    yield from exchange.entries(piece, own.grams, own.doc, shards)
        yield from exchange.entry_batches(rows())

    def cut(pieces: Iterator[Piece], table: pa.Table) -> pa.Table:
        answers = Answers(table)
        done = [_cut(piece, window, answers, shards) for piece in pieces]
        return pa.concat_tables(done) if done else pa.table(
            {"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()),
             "n_removed": pa.array([], pa.int64()), "removed": pa.array([], pa.list_(pa.int32())),
             "kept": pa.array([], pa.string())})

    sent = found.table.select("part", "piece", "blob").mapInArrow(send, exchange.ENTRIES)
    answers = written(exchange.recurring(sent, later=True), "answers")
    return exchange.with_answers(found, answers, cut, RESULT)


def contract(found: DataFrame) -> DataFrame:
    """The digest columns of `op2_substring_dedup`."""
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
