import hashlib
import random
import zlib

import pytest

from tickflow.llm import conversation_trie
from tickflow.llm.radix_tree import Node4, Node16, Node48, Node256, RadixTree

FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, name), (role, text)))
    turns = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        paths[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    saved = {p: (len(m) - 1) * (len(p[-1][1]) if p else 0) for p, m in members.items()}
    leaves = {p: 0 if p in children else 1 for p in members}
    for p in sorted(members, key=len, reverse=True):
        if p:
            saved[p[:-1]] += saved[p]
            leaves[p[:-1]] += leaves[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if paths[c] == p)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p],
                    saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed=1, n=260):
    rng = random.Random(seed)
    openings = [("system", f"opening {k}") for k in range(3)]
    rows = []
    for c in [*range(n), 1000, 1007, 2003, -5, -100, 5_000_000_123]:
        if rng.random() < 0.1:
            continue
        turns = [rng.choice(openings)] * (rng.random() < 0.7)
        turns += [(rng.choice(["user", "assistant", None]), rng.choice(["yes", "né", "", None, f"own {c}"]))
                  for _ in range(rng.randint(0, 9))]
        rows += [(c, k if k or rng.random() < 0.8 else None, r, t) for k, (r, t) in enumerate(turns)]
    rows += [(3001, 0, "user", "twice"), (3001, 0, "user", "twice"), (3001, 0, "user", "again"), (3001, None, None, None),
             (None, 0, "user", "lost"), (None, None, None, None)]
    rows += [(4000 + k, t, "user", f"copy {t}") for k in range(60) for t in range(7)]
    return rows


@pytest.mark.parametrize("segment,block_keys", [(512, 20_000), (3, 1)])
def test_trie_equals_brute_force(spark, segment, block_keys):
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 1, 2, "k") for r in rows],
                               "conv_id long, turn long, role string, text string, id string, pos int, level int, key string").repartition(5)
    found = conversation_trie.prefix_trie(df, segment, block_keys)
    assert found.columns == FIELDS
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows)


def test_long_conversation_and_long_text(spark):
    rows = [(7, k, "user", "a" * (k % 3)) for k in range(1300)] + [(8, k, "user", "a" * (k % 3)) for k in range(1290)]
    rows += [(9, 0, "user", "ü" * 200_000), (100, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((tuple(r) for r in conversation_trie.prefix_trie(df).collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    found = conversation_trie.prefix_trie(df)
    assert found.collect() == [] and found.columns == FIELDS


def walk(tree):
    """Keys and values of the tree in order, and the kinds of its nodes."""
    keys, kinds, stack = [], set(), [(tree.root, b"")] if tree.root else []
    while stack:
        node, head = stack.pop()
        kinds.add(type(node))
        at = head + node.prefix
        if node.value is not None:
            keys.append((at, node.value))
        stack += [(child, at + bytes([b])) for b, child in reversed(list(node.below()))]
    return keys, kinds


@pytest.mark.parametrize("alphabet,kind", [(3, Node4), (12, Node16), (40, Node48), (256, Node256)])
def test_radix_tree_keeps_order_and_grows(alphabet, kind):
    rng = random.Random(alphabet)
    letters = rng.sample(range(256), alphabet)
    keys = {bytes(rng.choice(letters) for _ in range(rng.randint(0, 9))) for _ in range(3000)}
    keys |= {bytes([b]) for b in letters}
    tree = RadixTree()
    for k in rng.sample(sorted(keys), len(keys)):
        tree.insert(k, k)
    found, kinds = walk(tree)
    assert found == [(k, k) for k in sorted(keys)]
    assert kind in kinds
    for node, begin, end in tree.upwards():
        assert end >= begin and (node.value is None or len(node.value) == end)
        # every inner node branches or holds a key: paths are compressed
        assert node.value is not None or len(list(node.below())) > 1
