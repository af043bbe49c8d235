import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tickflow.llm import decontamination, links, near_dedup, neighbours, packing, token_output
from tickflow.llm.queries import tokenizer_path
from tickflow.llm.tokens import Encoder, definition

WORDS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(definition(tokenizer_path()))


# --- tokens -----------------------------------------------------------------------------------

TRICKY = ["don't  we're\n\n'll 'sabc ''s x's'  \t a  b \n c", "<|endoftext|> a", "", "  ", "a\n\n\nb \n", "'", " 's", "x'",
          "中文字 1²½ é́  x　y\x1f\x85z I'D it'S 's", "'v 've 're", "a'r", "l'l", "l'll", "\x00\x1c a", "🙂🙂 ok", "ǅ ʰ ª٣ Ⅷ",
          " nbsp  em ls", "'s's't", "'really 'llama"]


def test_ids_are_those_of_the_tokenizer(encoder, corpus):
    texts = TRICKY + [t or "" for _, t in corpus]
    ids, counts = encoder.encode(texts)
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [x for w in want for x in w]


def test_ids_after_the_cache_was_dropped(encoder, corpus, monkeypatch):
    from tickflow.llm import tokens
    monkeypatch.setattr(tokens, "CACHE_PIECES", 50)
    test_ids_are_those_of_the_tokenizer(encoder, corpus)


# --- packing ----------------------------------------------------------------------------------

@pytest.mark.parametrize("capacity, groups, lengths", [
    (16, 1000, [1] * 5), (16, 3, [16, 16]), (1024, 1000, None), (1024, 20, None), (10, 4, [7, 7, 7, 3, 3, 3, 3, 5, 5, 5, 1])])
def test_plan_places_every_piece_once(capacity, groups, lengths):
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, capacity + 1, 3000).tolist() if lengths is None else lengths
    planned = packing.plan(dict(Counter(lengths)), capacity, groups)
    seen, cells = Counter(), {}
    for length, first, last, sequence, width, place in planned.runs:
        for rank in range(first, last):
            seen[length, rank] += 1
            turn, column = divmod(rank - first, width)
            cells.setdefault(sequence + column, []).append((place + turn * length, length))
    assert seen == Counter((n, k) for n, c in Counter(lengths).items() for k in range(c))
    for own in cells.values():
        own.sort()
        ends = [0] + [a + n for a, n in own]
        assert [a for a, _ in own] == ends[:-1] and ends[-1] <= capacity
    assert len(cells) == planned.sequences
    if capacity == 1024 and groups == 1000:
        assert planned.sequences <= 1.015 * -(-sum(lengths) // capacity)
        assert planned.sequences <= len(token_output.best_fit(np.array(lengths), capacity)) + 8


def test_cuts():
    assert packing.cuts(5, 10) == [(0, 5)] and packing.cuts(10, 10) == [(0, 10)]
    assert packing.cuts(25, 10) == [(0, 5), (5, 10), (15, 10)] and packing.cuts(20, 10) == [(0, 10), (10, 10)]


def test_pack(spark, documents, corpus, encoder):
    rows = corpus + [(None, "no id")]
    got = packing.pack(documents(rows), tokenizer_path(), capacity=64).collect()
    ids = Counter()
    for i, t in rows:
        own = encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        for piece, (a, n) in enumerate(packing.cuts(len(own), 64)):
            ids[i, piece, a, n, zlib.crc32(np.array(own[a:a + n], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == ids
    cells = {}
    for r in got:
        cells.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in cells.values():
        own.sort()
        ends = [0] + [a + n for a, n in own]
        assert [a for a, _ in own] == ends[:-1] and ends[-1] <= 64
    assert packing.pack(documents([]), tokenizer_path()).count() == 0


@pytest.mark.parametrize("n", [0, 1, 50, 2000])
def test_best_fit_equals_a_plain_search(n):
    lengths = np.random.default_rng(n).integers(1, 101, n)
    room, want = [], []
    for k in np.argsort(-lengths, kind="stable"):
        fits = [r for r in range(len(room)) if room[r] >= lengths[k]]
        tight = min((room[r] for r in fits), default=None)
        b = next((r for r in fits if room[r] == tight), None)
        if b is None:
            b = len(room)
            room.append(100)
            want.append([])
        room[b] -= lengths[k]
        want[b].append(k)
    got = token_output.best_fit(lengths, 100)
    assert sorted(k for own in got for k in own) == list(range(n))
    assert sorted(sum(lengths[k] for k in own) for own in got) == sorted(sum(lengths[k] for k in own) for own in want)


def test_packed_ids_round_trip(documents, corpus, encoder, tmp_path, spark):
    rows = [(k, t) for k, (_, t) in enumerate(corpus)] + [(None, "no id")]
    packed = token_output.packed_ids(documents(rows), tokenizer_path(), capacity=128, group_ids=1000)
    token_output.write_matrices(packed, str(tmp_path / "m"))
    found = {}
    for r in spark.read.parquet(str(tmp_path / "m")).collect():
        ids = np.frombuffer(r["ids"], "<u4")
        cu = r["cu_seqlens"]
        assert len(ids) == 128 and cu[0] == 0 and cu[-1] == r["n_ids"] and (ids[cu[-1]:] == 0).all()
        assert r["position_resets"] == cu[:-1]
        assert (token_output.positions(cu)[r["position_resets"]] == 0).all()
        for d, start, a, b in zip(r["doc_ids"], r["starts"], cu, cu[1:]):
            found.setdefault(d, []).append((start, ids[a:b].tolist()))
    for i, t in rows:
        own = encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        assert [x for _, part in sorted(found[i]) for x in part] == own
    assert token_output.packed_ids(documents([]), tokenizer_path()).count() == 0


# --- neighbours -------------------------------------------------------------------------------

def brute_nearest(rows, queries, k):
    out = {}
    for q, v in queries:
        near = sorted((float(np.sqrt(((np.array(v, float) - np.array(w, float)) ** 2).sum())), i)
                      for i, w in rows if i != q and len(w) == len(v))
        out[q] = near[:k]
    return out


def test_chi_square():
    assert abs(neighbours.chi_square_cdf(15.507, 8) - 0.95) < 1e-4
    assert abs(neighbours.chi_square_quantile(0.95, 8) - 15.507) < 1e-2


@pytest.mark.parametrize("block_values", [10**6, 3000])
def test_nearest(spark, block_values):
    rng = np.random.default_rng(6)
    good = [(k, rng.normal(size=16).round(3).tolist()) for k in range(900)]
    good += [(1000 + k, good[5][1]) for k in range(40)] + [(2000, [1.0, 2.0]), (2001, [1.0, 3.0])]
    bad = [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [None] + [1.0] * 15), (3004, []),
           (None, good[0][1]), (3005, [float("inf")] + [1.0] * 15)]
    frame = spark.createDataFrame([(i, v, i) for i, v in good + bad], "vec_id long, embedding array<double>, dim long")
    got = neighbours.nearest(frame, frame.where("vec_id % 20 = 0"), k=10, block_values=block_values).collect()
    want = brute_nearest(good, [(i, v) for i, v in good if i % 20 == 0], 10)
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(by[r["query_id"]])
    assert set(by) == set(want)
    assert all(own == sorted(own) and len(own) == len(want[q]) for q, own in by.items())
    hit = sum(len(set(by[q]) & set(own)) for q, own in want.items())
    assert hit >= 0.95 * sum(map(len, want.values()))
    assert by[2000] == [(1.0, 2001)]
    assert neighbours.nearest(frame.limit(0), frame, k=3).count() == 0


# --- decontamination --------------------------------------------------------------------------

def brute_hits(text, items):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = [False] * len(words), set()
    for name, item in items:
        own = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), item or ""))
        n = min(10, len(own))
        windows = {tuple(own[k:k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(words) - n + 1 if n else 0):
            if tuple(words[k:k + n]) in windows:
                hit[k:k + n] = [True] * n
                found.add(str(name))
    return len(words), sum(hit), sorted(found)


@pytest.mark.parametrize("part_bytes", [10**6, 300])
def test_contamination(spark, documents, corpus, part_bytes):
    base = [" ".join((t or "").split()) for _, t in corpus]
    items = [(k, base[k][10:150]) for k in range(0, 40, 3)]
    items += [(70, "a B,c"), (71, ""), (72, None), (73, "the of the of the of the of the of the"), (7, base[3][:90]), (70, "x")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    rows = corpus + [(None, items[0][1]), (None, None)]
    got = decontamination.contract(decontamination.contamination(documents(rows), bench, part_bytes=part_bytes)).collect()
    want = []
    for i, t in rows:
        n, hit, found = brute_hits(t, items)
        want.append((str(i), n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    clean = decontamination.clean(documents(rows), bench, part_bytes=part_bytes)
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(i for i, t in rows if not brute_hits(t, items)[1])
    none = decontamination.contamination(documents(rows), bench.limit(0))
    assert none.where("size(items) > 0").count() == 0 and none.count() == len(rows)


# --- near duplicates --------------------------------------------------------------------------

def test_components(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 101), (100, 102), (103, 101), (200, 201)]
    found = {r["node"]: r["component"] for r in links.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {found[k] for k in range(41)} == {0} and {found[k] for k in range(100, 104)} == {100} and found[201] == 200
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_similarity(a, b, sampler):
    import pyarrow as pa
    s = near_dedup.Shingles(pa.array([a, b], pa.string()))
    w = sampler.weights(s)
    x, y = ({int(v): float(q) for v, q, t in zip(s.value, w, s.text) if t == k} for k in (0, 1))
    common = sum(min(x[v], y[v]) for v in x.keys() & y.keys())
    total = sum(x.values()) + sum(y.values()) - common
    return common / total if total else 0.0


def test_near_duplicates(spark, documents):
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(500)]
    rows, true = [], []
    for group in range(12):
        text = [words[j] for j in rng.integers(0, 500, int(rng.integers(40, 200)))]
        for copy in range(6):
            own = list(text)
            for _ in range(copy // 2):
                own[int(rng.integers(0, len(own)))] = "edit" + str(rng.integers(0, 10**6))
            rows.append((len(rows), " ".join(own)))
            true.append(group)
    rows += [(500 + k, " ".join(words[j] for j in rng.integers(0, 500, 80))) for k in range(60)]
    rows += [(900, None), (901, ""), (902, "..."), (903, "a b"), (904, "A  b!"), (None, rows[0][1]), (905, rows[0][1]),
             (905, rows[0][1]), (906, "a c")]
    docs = documents(rows)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert len(got) == len({i for i, _ in rows if i is not None})
    frequency, n = near_dedup.frequencies(docs.where("doc_id is not null"))
    sampler = near_dedup.Sampler(frequency, n)
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    named = [(i, t) for i, t in rows if i is not None]
    for k, (i, t) in enumerate(named):
        for j, u in named[:k]:
            if t and u and brute_similarity(t, u, sampler) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    want = {i: root(i) for i in parent} | {900: 900, 901: 900, 902: 900}
    assert got == want
    assert near_dedup.near_duplicates(documents([])).count() == 0


def test_samples_agree_as_often_as_texts_are_similar():
    import pyarrow as pa
    rng = np.random.default_rng(2)
    text = [f"w{k}" for k in rng.integers(0, 10**6, 3000)]
    other = list(text)
    for k in range(0, 3000, 40):
        other[k] = "x"
    sampler = near_dedup.Sampler(np.ones(near_dedup.COUNTERS), 100)
    a, b = " ".join(text), " ".join(other)
    similarity = brute_similarity(a, b, sampler)
    agree = []
    for seed in range(12):
        s = near_dedup.Shingles(pa.array([f"{x} " for x in (a, b)], pa.string()))
        s.value = near_dedup.mix(s.value + np.uint64(seed * 7919))
        order = np.lexsort((s.value, s.text))
        s.value, s.text, s.count = s.value[order], s.text[order], s.count[order]
        x, y = sampler.samples(s)
        agree.append(np.mean(x == y))
    assert abs(np.mean(agree) - similarity) < 0.06


def test_near_duplicates_in_buckets_that_share_a_passage(spark, documents):
    """A thousand texts share a passage, so they meet in hot buckets; every alike pair with a common band is linked."""
    import pyarrow as pa
    rng = random.Random(23)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    passage, rows = words(100), []
    for k in range(500):
        own = words(12)
        rows += [(2 * k, " ".join(passage + own)), (2 * k + 1, " ".join(passage + own[:-8] + words(8)))]
    docs = documents(rows)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}

    sampler = near_dedup.Sampler(*near_dedup.frequencies(docs))
    texts = pa.array([t for _, t in rows])
    samples = sampler.samples(near_dedup.Shingles(texts))
    bands = samples.reshape(len(rows) // 2, 2, near_dedup.BANDS, near_dedup.ROWS)
    shared = (bands[:, 0] == bands[:, 1]).all(axis=2).any(axis=1)
    even = np.arange(0, len(rows), 2)
    alike = near_dedup.similarities(sampler, texts.take(pa.array(even)), texts.take(pa.array(even + 1)))
    pairs = [int(i) for i in even[shared & (alike >= near_dedup.SIMILARITY)]]
    assert len(pairs) > 300 and len(set(got.values())) > 400      # the passage alone links nobody
    assert [i for i in pairs if got[i] != got[i + 1]] == []


def test_signs_tell_agreeing_samples(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(-2**62, 2**62, (400, near_dedup.BANDS * near_dedup.ROWS))
    b = np.where(rng.random(a.shape) < rng.random((400, 1)), a, a + rng.integers(1, 64, a.shape))
    agreeing = (a == b).sum(axis=1)
    pairs = spark.createDataFrame([(k, x.tolist(), y.tolist()) for k, (x, y) in enumerate(
        zip(near_dedup.sample_signs(a), near_dedup.sample_signs(b)))], "k long, x array<long>, y array<long>")
    got = {r["k"] for r in pairs.where(near_dedup._agree("x", "y")).collect()}
    assert got == set(np.flatnonzero(agreeing >= near_dedup.AGREE).tolist()) and 50 < len(got) < 350
    assert (near_dedup.band_hashes(a)[:, 0] != near_dedup.band_hashes(a)[:, 1]).all()


def test_a_packing_task_needs_little_memory_and_returns_it(monkeypatch):
    """Two megabytes of text in one batch are encoded below 40 MB, with the ids of single texts, and memory is given back."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from tickflow.llm import tokens, words
    rng = np.random.default_rng(3)
    some = np.array([f"word{k} " for k in range(500)])
    texts = ["".join(rng.choice(some, 300)) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    encode = tokens.encoder(tokens.definition(tokenizer_path())).encode
    want = [encode([t])[0] for t in texts]
    returned = []
    monkeypatch.setattr(words, "return_memory", lambda: returned.append(1))
    tracemalloc.start()
    got = [encode(part.column("text").to_pylist()) for part in words.slices(iter([batch]), size=packing.PIECE_BYTES)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (np.concatenate([ids for ids, _ in got]) == np.concatenate(want)).all()
    assert np.concatenate([n for _, n in got]).tolist() == [len(w) for w in want]
    assert peak < 40 << 20 and returned == [1]
