"""Token ids of whole texts: every distinct piece of text is given to the tokenizer once per task.

A byte-level tokenizer first cuts a text into words, numbers, runs of signs and white space, and then
encodes each piece by itself. The cutting is done here for a whole slice at once, the encoding by the
tokenizer, whose own pre-tokenizer also names the class of every character that is not Latin.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from tokenizers import Tokenizer

from tickflow.llm.words import mix, running, span_hash

LETTER, NUMBER, SIGN, SPACE, UNKNOWN = 0, 1, 2, 3, 255
CACHE_PIECES = 1_500_000      # distinct pieces a worker remembers


class Encoder:
    """ids of texts as the tokenizer file gives them (no special tokens added)."""

    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.values = mix(np.arange(1, 0x110001, dtype=np.uint64))
        self._forget()
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)      # ids whose text starts with a blank
        for token, number in vocabulary.items():
            self.opens[number] = token.startswith("Ġ")

    def _forget(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.begin = np.empty(0, np.int64)
        self.count = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int32)

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, one behind another, and the number of ids of each text."""
        plain = ["" if any(s in t for s in self.specials) else t for t in texts]
        ids, counts = self._encode_plain(plain)
        odd = [k for k, (a, b) in enumerate(zip(texts, plain)) if a != b]
        if not odd:
            return ids, counts
        ends = np.cumsum(counts)
        parts, last = [], 0
        for k in odd:                                 # texts that spell a special token go to the tokenizer whole
            own = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, np.int32)
            parts += [ids[last:ends[k]], own]
            last, counts[k] = ends[k], len(own)
        return np.concatenate([*parts, ids[last:]]), counts

    def _encode_plain(self, texts):
        text = "".join(texts)
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        if not text:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = self._starts(points, bounds)
        ends = np.append(starts[1:], len(points))
        keys = span_hash(running(self.values[points]), starts, ends)
        which, distinct = pd.factorize(keys)
        first = np.empty(len(distinct), np.int64)
        first[which[::-1]] = np.arange(len(keys) - 1, -1, -1)
        order = np.argsort(distinct)
        row = np.empty(len(distinct), np.int64)
        row[order] = self._rows(distinct[order], text, starts[first[order]], ends[first[order]])
        row = row[which]
        n = self.count[row]
        total = np.cumsum(n)
        offset = np.repeat(self.begin[row] - (total - n), n) + np.arange(total[-1])
        piece_bounds = np.searchsorted(starts, bounds)
        cut = np.concatenate(([0], total))[piece_bounds]
        return self.ids[offset], np.diff(cut)

    def _rows(self, distinct, text, starts, ends):
        """Places of the pieces in the worker's cache; pieces that are new to it are encoded."""
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        if not known.all():
            if len(self.keys) + len(distinct) > CACHE_PIECES:
                self._forget()
                known[:] = False
            new = np.flatnonzero(~known)
            ids, count = self._pieces([text[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            begin = len(self.ids) + np.cumsum(count) - count
            self.ids = np.concatenate((self.ids, ids))
            place = np.searchsorted(self.keys, distinct[new])
            self.begin = np.insert(self.begin, place, begin)
            self.count = np.insert(self.count, place, count)
            self.keys = np.insert(self.keys, place, distinct[new])
            at = np.searchsorted(self.keys, distinct)
        return at

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of single pieces. Words that open with a blank go to the tokenizer as running text."""
        count = np.zeros(len(pieces), np.int64)
        blank = np.array([len(p) > 1 and p[0] == " " and p[1] != " " for p in pieces], bool)
        runs, others = np.flatnonzero(blank), np.flatnonzero(~blank)
        found: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
        for a in range(0, len(runs), 4096):
            group = runs[a:a + 4096]
            ids = np.array(self.tokenizer.encode("".join(pieces[k] for k in group), add_special_tokens=False).ids,
                           np.int32)
            opens = np.flatnonzero(self.opens[ids])
            if len(opens) == len(group):
                for k, own in zip(group, np.split(ids, opens[1:])):
                    found[k] = own
            else:                                     # a blank of its own would shift the rest: one by one
                others = np.concatenate((others, group))
        for k, e in zip(others, self.tokenizer.encode_batch([pieces[k] for k in others], add_special_tokens=False)):
            found[k] = np.array(e.ids, np.int32)
        count[:] = [len(x) for x in found]
        return np.concatenate(found) if found else np.empty(0, np.int32), count

    def _classify(self, points: np.ndarray) -> np.ndarray:
        kinds = self.classes[points]
        if (kinds == UNKNOWN).any():
            split = self.tokenizer.pre_tokenizer.pre_tokenize_str
            for point in np.unique(points[kinds == UNKNOWN]).tolist():
                c = chr(point)
                kind = SPACE
                for name, sample in ((LETTER, "a"), (NUMBER, "1"), (SIGN, "!")):
                    if len(split(sample + c)) == 1:
                        kind = name
                        break
                self.classes[point] = kind
            kinds = self.classes[points]
        return kinds

    def _starts(self, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where the pieces of 's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?signs+|\\s+(?!\\S)|\\s+ begin."""
        n = len(points)
        kind = self._classify(points)
        opening = np.zeros(n + 1, bool)
        opening[bounds] = True                        # a text begins here; also true at the end
        space = kind == SPACE
        start = opening[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        # A blank goes with what follows it; of more white space only the last place can.
        goes_on = np.zeros(n, bool)
        goes_on[:-1] = space[:-1] & ~space[1:] & ~opening[1:n]
        start |= goes_on
        joined = np.flatnonzero(goes_on & (points == 32)) + 1
        start[joined] = False
        mark = np.flatnonzero(start & (points == 39))
        mark = mark[mark + 1 < n]
        mark = mark[~opening[mark + 1]]
        one = points[mark + 1]
        short = np.isin(one, [ord(c) for c in "stmd"])
        two = points[np.minimum(mark + 2, n - 1)]
        long = (mark + 2 < n) & ~opening[np.minimum(mark + 2, n)]
        long &= ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        for where, width in ((mark[short], 2), (mark[long], 3)):
            start[where + 1] = False
            after = where + width
            start[after[after < n]] = True
        return np.flatnonzero(start)


@lru_cache(maxsize=2)
def encoder(definition: str) -> Encoder:
    """One encoder per worker and tokenizer; it keeps its cache between tasks."""
    return Encoder(definition)


def definition(path: str) -> str:
    """The tokenizer file's text, which the driver sends to the executors (a few megabytes at most)."""
    with open(path, encoding="utf-8") as file:
        return file.read()
