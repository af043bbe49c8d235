import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tickflow.llm import line_dedup, substring_dedup, suffix_dedup

SPACES = re.compile("[^\x20\x09-\x0D]+")


def removed(units, rows, n):
    """Covered places per row: windows of n units that a smaller id has as well."""
    first = {}
    for i, u in zip((r[0] for r in rows), units):
        if i is not None:
            for k in range(len(u) - n + 1):
                first[u[k:k + n]] = min(first.get(u[k:k + n], i), i)
    out = []
    for (i, _), u in zip(rows, units):
        gone = [False] * len(u)
        for k in range(len(u) - n + 1):
            if i is not None and first[u[k:k + n]] < i:
                gone[k:k + n] = [True] * n
        out.append(gone)
    return out


def runs(gone):
    return sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))


def test_words(documents, corpus):
    rows = corpus + [(None, corpus[0][1]), (None, None)]
    units = [tuple(SPACES.findall(t or "")) for _, t in rows]
    want = sorted((str(i), len(u), sum(g), hashlib.sha256(" ".join(x for x, y in zip(u, g) if not y).encode()).hexdigest())
                  for (i, _), u, g in zip(rows, units, removed(units, rows, 13)))
    got = substring_dedup.contract(substring_dedup.repeated_passages(documents(rows))).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == want
    assert sum(w[2] for w in want) > 100
    assert substring_dedup.repeated_passages(documents([])).count() == 0


def test_several_automata_and_pieces(documents, corpus, monkeypatch):
    from tickflow.llm import exchange
    monkeypatch.setattr(substring_dedup, "AUTOMATON_BLOCKS", 7)
    whole = sorted(substring_dedup.repeated_passages(documents(corpus)).drop("kept").collect(), key=str)
    parts = exchange.parts
    monkeypatch.setattr(exchange, "parts", lambda docs: parts(docs, piece_bytes=500))
    monkeypatch.setattr(exchange, "SHARD_ENTRIES", 100)
    cut = sorted(substring_dedup.repeated_passages(documents(corpus, 5)).drop("kept").collect(), key=str)
    assert whole == cut


def test_bytes(documents, corpus, monkeypatch):
    rows = corpus + [(None, corpus[0][1]), (None, None)]
    units = [(t or "").encode() for _, t in rows]
    want = sorted((str(i), len(u), sum(g), runs(g), hashlib.sha256(bytes(x for x, y in zip(u, g) if not y)).hexdigest())
                  for (i, _), u, g in zip(rows, units, removed(units, rows, 50)))
    found = suffix_dedup.contract(suffix_dedup.repeated_strings(documents(rows)))
    assert sorted((str(r[0]), *r[1:]) for r in found.collect()) == want
    from tickflow.llm import exchange
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 700)
    monkeypatch.setattr(exchange, "SHARD_ENTRIES", 50)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 3000)
    found = suffix_dedup.contract(suffix_dedup.repeated_strings(documents(rows, 5)))
    assert sorted((str(r[0]), *r[1:]) for r in found.collect()) == want
    assert suffix_dedup.repeated_strings(documents([])).count() == 0


@pytest.mark.parametrize("shard", [60, 1000, 10**6])
def test_merged_transforms_find_equal_windows(monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    rng = np.random.default_rng(1)
    pool = [rng.integers(97, 100, 40, dtype=np.uint8) for _ in range(6)]
    texts = [np.concatenate([pool[j] for j in rng.integers(0, 6, 3)])[int(rng.integers(0, 9)):] for _ in range(50)]
    doc = rng.integers(0, 30, 50)
    lengths = np.array([len(t) for t in texts])
    got = suffix_dedup.first_documents(np.concatenate(texts), lengths, doc, 50)
    least = defaultdict(lambda: 99)
    for t, d in zip(texts, doc):
        for k in range(len(t) - 49):
            w = t[k:k + 50].tobytes()
            least[w] = min(least[w], d)
    assert got.tolist() == [least[t[k:k + 50].tobytes()] for t in texts for k in range(len(t) - 49)]


def test_transform_is_that_of_the_sorted_suffixes():
    rng = np.random.default_rng(3)
    parts = [rng.integers(97, 99, n, dtype=np.uint8).tobytes() for n in (40, 60, 55)]
    text = np.frombuffer(b"".join(p + b"\xff" for p in parts), np.uint8)
    t = suffix_dedup.Transform(text)
    data = text.tobytes() + b"\xff" * 200
    want = sorted(range(len(text)), key=lambda k: data[k:k + 128])
    assert [data[k:k + 128] for k in t.position] == [data[k:k + 128] for k in want]
    assert all(t.position[t.longer[k]] == (t.position[k] - 1) % len(text) for k in range(len(text)))


def lcs_places(a, b):
    return line_dedup.patience(a, b)


@pytest.mark.parametrize("a, b, want", [
    ([], [1], []), ([1, 2, 3], [1, 2, 3], [0, 1, 2]), ([1, 2, 3], [9, 2, 3], [1, 2]), ([1, 2, 3, 4], [1, 9, 3, 4], [0, 2, 3]),
    ([1, 2, 3], [3, 2, 1], [2]), ([5, 5, 7, 5], [5, 7, 5, 5], [0, 1, 3]), ([1, 1, 1], [1, 1], [0, 1])])
def test_patience(a, b, want):
    got = lcs_places(a, b)
    it = iter(a)
    assert all(any(x == b[k] for x in it) for k in got)           # an alignment: in order in both
    if want != [2] and a[:1] != [5]:
        assert got == want


def test_lines(documents):
    long = [f"line {k} of the first text" for k in range(30)]
    rows = [(1, "\n".join(long)), (2, "\n".join(long[:10] + ["new"] + long[10:])), (3, "\n".join(long)),
            (4, "its own\n\nlines"), (5, None), (6, ""), (None, "\n".join(long)), (4, "its own\n\nlines"),
            (7, "other\nits own\n\nlines\n")]
    got = {(r["doc_id"], r["text"]): r for r in line_dedup.dedup_lines(documents(rows)).collect()}
    assert len(got) == 8
    assert got[2, "new"]["__n_removed"] == 30 and got[3, ""]["__n_removed"] == 30 and got[1, rows[0][1]]["__n_removed"] == 0
    assert got[None, rows[0][1]]["__n_removed"] == 0 and got[5, None]["__n_lines"] == 0
    assert got[7, "other\n\n"]["__n_removed"] == 2
    assert line_dedup.dedup_lines(documents([])).count() == 0


def test_a_group_of_copies_and_a_common_line(documents):
    rows = [(k, f"common\nown {k}\n" + "\n".join(f"body {j}" for j in range(9)) + f"\nend {k % 3}") for k in range(60)]
    rows += [(100 + k, f"common\nalone {k}") for k in range(20)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(rows), rare_least=2).collect()}
    assert got[0] == rows[0][1]
    for k in range(3, 60):
        assert got[k] == f"own {k}"
    assert got[100] == "alone 0"


def brute_lines(rows, rare):
    """Rows of dedup_lines by plain loops."""
    lines = {i: [x for x in (t or "").split("\n") if x] for i, t in rows}
    first = {}
    for i in sorted(lines):
        first.setdefault(tuple(lines[i]), i)
    nodes = {i: v for v, i in first.items() if v}
    holders = defaultdict(list)
    for i in sorted(nodes):
        for x in set(nodes[i]):
            holders[x].append(i)
    out = {}
    for i, v in lines.items():
        if not v:
            continue
        home = first[tuple(v)]
        if home < i:
            out[i] = len(v)
            continue
        shared = {x: len(holders[x]) for x in set(v) if holders[x][0] < i}
        partners = {holders[x][0] for x, n in shared.items() if n <= rare or n == min(shared.values())}
        gone = {k for e in partners for k in line_dedup.patience(nodes[e], v)}
        partners |= {holders[x][0] for k, x in enumerate(v) if k not in gone and x in shared}
        out[i] = len({k for e in partners for k in line_dedup.patience(nodes[e], v)})
    return out


def test_lines_equal_brute_force(documents):
    rng = np.random.default_rng(8)
    rows = [(k, "\n".join(f"l{int(x)}" for x in rng.zipf(1.4, int(rng.integers(0, 12))) % 60)) for k in range(120)]
    got = {r["doc_id"]: r["__n_removed"] for r in line_dedup.dedup_lines(documents(rows), rare_least=4).collect()}
    want = brute_lines(rows, 4)
    assert {i: n for i, n in got.items() if i in want} == want


def test_every_shared_line_is_cut_however_many_hold_it(documents):
    """Lines that half of the texts hold go as well, though each text also has rarer leads to other partners."""
    rng = random.Random(5)
    notices = [f"notice {k} that many hold" for k in range(6)]
    rows = []
    for k in range(300):
        text = [f"own {k}"] + [f"pair {k // 2}"] + sorted(rng.sample(notices, 3)) + [f"end {k}"]
        rows.append((k, "\n".join(text)))
    got = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.dedup_lines(documents(rows), rare_least=3).collect()}
    first = {}
    for k, t in rows:
        for x in t.split("\n"):
            first.setdefault(x, k)
    for k, t in rows:                      # all texts have them in one order, so nothing stands in the way
        assert got[k] == [x for x in t.split("\n") if first[x] == k]


@pytest.mark.parametrize("bits", [1 << 28, 8])
def test_common_order(monkeypatch, bits):
    monkeypatch.setattr(line_dedup, "TABLE_BITS", bits)
    rng = random.Random(7)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = line_dedup.common_order(a, b)
        it = iter(a)
        assert got == sorted(set(got)) and all(any(x == b[k] for x in it) for k in got) and len(got) == best[-1][-1]


def test_lines_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a\nb", 5, "x", 7), (2, "b\nc", 6, None, 8)],
                                 "doc_id long, text string, __id long, __marks string, __n_lines long")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(rows).collect()}
    assert got[2]["text"] == "c" and got[2]["__id"] == 6 and got[1]["__marks"] == "x" and got[2]["__n_lines"] == 2


@pytest.mark.parametrize("shards", [1, 7, 5000])
def test_answers_come_back_to_their_hashes(shards):
    """What a piece sends by shard and what it reads from the answers are the same hashes, however many shards there are."""
    import pyarrow as pa
    from tickflow.llm import exchange
    rng = np.random.default_rng(shards)
    hashes = rng.integers(0, 2**64, 3000, dtype=np.uint64)[rng.integers(0, 3000, 6000)]
    doc = np.sort(rng.integers(0, 40, 6000))
    piece = exchange.Piece(3, 1, pa.array(range(100, 140), pa.int64()), pa.array(["x"] * 40))
    wanted = set(np.unique(hashes)[::3].tolist())
    rows, sent = [], 0
    _, first = np.unique(hashes, return_index=True)
    own = hashes[np.sort(first)]
    for s, part, number, n, low, docs in exchange.entries(piece, hashes, doc, shards):
        mine = own[exchange.shard_of(own, shards) == s]
        assert mine.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :exchange.KEPT].tobytes() == low
        ids, counts = exchange.unpack(docs, "<i8", "<i4")
        assert counts.sum() == n == len(mine) and set(ids.tolist()) <= set(range(100, 140))
        sent += n
        rows.append((part, number, s, n, exchange.pack(np.packbits([int(h) in wanted for h in mine]))))
    answers = pa.table(dict(zip(("part", "piece", "shard", "n", "bits"), map(list, zip(*rows[::-1])))))
    assert sent == len(own)
    assert exchange.Answers(answers).flagged(piece, hashes, shards).tolist() == sorted(wanted)
