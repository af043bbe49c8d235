import random
import re
from collections import Counter

import numpy as np
import pytest

from tickflow.llm import collocations
from tickflow.llm.collocations import HatTrie


def brute(rows, least, top, covered):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    f[lang, tuple(words[i:i + n])] += 1
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    found = []
    for (lang, p), a in candidates.items():
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(len(q) > len(p) and other == lang and 100 * b >= covered * a
                     and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                     for (other, q), b in candidates.items())
        if not inside:
            found.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, total[lang], -score))
    return out


def texts(seed=3):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Und", "é", "ß1", "x-y", "A\x0bb", "日本"] + [f"w{k}" for k in range(12)]
    rows = []
    for k in range(90):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if k % 3 == 0:
            words[5:5] = ["new", "york", "city", "hall"]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ", ", "\n", "!"]) for w in words)
        rows.append((rng.choice(["en", "fr", "und", None]), text))
    rows += [("en", None), (None, ""), ("en", "  \n"), ("xx", "only once"), ("en", rows[0][1]), ("en", rows[0][1])]
    return rows + [("de", "wie so oft " * 40_000)]


@pytest.mark.parametrize("burst,held", [(4096, 1 << 20), (3, 50)])
def test_collocations_equal_brute_force(spark, burst, held):
    rows = texts()
    docs = spark.createDataFrame([(t, g, 1, "k", 2, 3) for g, t in rows],
                                 "text string, lang string, w1 int, word string, f int, c int").repartition(3)
    for least, top, covered in ((3, 2000, 80), (2, 25, 60)):
        got = sorted(tuple(r) for r in collocations.collocations(docs, least, top, covered, burst, held).collect())
        assert got == sorted(brute(rows, least, top, covered))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.collocations(docs).collect() == []


@pytest.mark.parametrize("words", [1, 2, 3, 4])
def test_trie_bursts_and_spills_whole_counts(words):
    rng = np.random.default_rng(words)
    want, got = Counter(), Counter()
    trie = HatTrie(words, burst=4, held=64)

    def take(run):
        ids, counts = run
        rows = [tuple(r) for r in ids.tolist()]
        assert rows == sorted(rows)
        got.update(dict(zip(rows, counts.tolist())))

    spilled = 0
    for _ in range(40):
        ids = np.unique(rng.integers(0, 5 if words > 1 else 500, (60, words)).astype(np.uint64), axis=0)
        counts = rng.integers(1, 9, len(ids))
        want.update(dict(zip(map(tuple, ids.tolist()), counts.tolist())))
        trie.add(ids, counts)
        if trie.size > trie.held:
            for run in trie.spill():
                take(run)
                spilled += 1
            assert trie.size <= trie.held
    for run in trie.spill(everything=True):
        take(run)
    assert got == want and trie.size == 0
    assert words < 3 or spilled


def test_scores_beyond_64_bits(spark):
    big = 5 * 10**15
    tables = [spark.createDataFrame([(1, big + 7), (2, big)], "w1 long, f long"),
              spark.createDataFrame([(1, 2, big - 11)], "w1 long, w2 long, f long")]
    row = collocations._scored(tables[1], tables, 2).first()
    assert row["score"] == 2000000 * (big - 11) // (2 * big + 7)
