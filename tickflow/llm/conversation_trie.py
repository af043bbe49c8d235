"""Prefix trie of conversations: who shares which first turns, and how much text that saves.

A turn is known by a 16-byte id. The ids of a conversation make up its key; keys are sorted into ranges, and
tasks put blocks of them into adaptive radix trees, of which only the depths between two turns are nodes. A
subtree lies within one block, but for the nodes on the paths to a block's first and last key: these open
nodes, a few for each block, are added up afterwards. Long conversations are cut into segments of SEGMENT
turns, and the segments further down are done first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickflow.llm.radix_tree import RadixTree
from tickflow.llm.words import return_memory
from tickflow.order import dense_position
from tickflow.runtime import attach, written

ID = 16                   # bytes of a turn id
START = 16                # bytes before the turn ids that tell what came before a segment
SEGMENT = 512             # turns of one key
BLOCK_KEYS = 20_000       # keys of one tree
BLOCK_BYTES = 16 << 20
HEADS = 5                 # turns that may be taken from the first conversation of a hundred

NODE = ("depth int, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens decimal(38,0), "
        "parent_conv_id long, open binary, parent_open binary, above array<binary>, length long, "
        "start binary, next binary")
_COLUMNS = ["depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "parent_conv_id", "open",
            "parent_open", "above", "length", "start", "next"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, id, length: the turns of each conversation in order, from 0.

    Turns are in order of `turn` (NULL first); those with equal numbers are in order of their ids. A NULL
    role or text is empty; rows without a conv_id are left out; further columns are ignored.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("id"),
        F.char_length(text).cast("long").alias("length"))
    return written(dense_position(slim, "conv_id", ["turn", "id"], "pos"), "turns").drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of all conversations, and their rebuilt turns conv_id, pos, id, length: the first h turns of
    conversation c - c % 100, then the own ones after the first h; h is crc32 of the decimal id modulo 6."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    heads = (turns.where(F.col("pos") < HEADS).groupBy(F.col("conv_id").alias("base"))
             .agg(F.sort_array(F.collect_list(F.struct("pos", "id", "length"))).alias("head")))
    convs = written(turns.where("pos = 0").select("conv_id"), "conversations")
    taken = (convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).join(heads, "base")
             .select("conv_id", F.explode(F.slice("head", F.lit(1), h.cast("int"))).alias("t"))
             .select("conv_id", F.lit(0).alias("side"), "t.pos", "t.id", "t.length"))
    own = turns.where(F.col("pos") >= h).select("conv_id", F.lit(1).alias("side"), "pos", "id", "length")
    both = taken.unionByName(own).withColumnRenamed("pos", "place")
    return convs, dense_position(both, "conv_id", ["side", "place"], "pos").select("conv_id", "pos", "id", "length")


def segments(convs: DataFrame, turns: DataFrame, size: int = SEGMENT) -> DataFrame:
    """conv_id, level, start, key, lengths, next, last: the cut turns of each conversation.

    `start` tells what the conversation held before, `next` what it holds up to the end of the segment.
    """
    part = (turns.groupBy("conv_id", F.expr(f"pos div {size}").cast("int").alias("level"))
            .agg(F.sort_array(F.collect_list(F.struct("pos", "id", "length"))).alias("t"))
            .select("conv_id", "level", F.unhex(F.array_join(F.col("t.id"), "")).alias("key"),
                    F.col("t.length").alias("lengths")))
    bare = convs.join(part.select("conv_id").distinct(), "conv_id", "left_anti").select(
        "conv_id", F.lit(0).alias("level"), F.lit(b"").alias("key"), F.array().cast("array<bigint>").alias("lengths"))
    # the turns so far are known by the exclusive-or of two hashes of each segment and its place
    marks = [F.xxhash64("level", "key"), F.xxhash64("key", "level")]
    order = W.partitionBy("conv_id").orderBy("level")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    names = [f"mark{k}" for k in range(len(marks))]
    slim = written(part.unionByName(bare).select("*", *[m.alias(n) for m, n in zip(marks, names)]), "segments")
    chain = slim.select("conv_id", "level", *names).select(
        "conv_id", "level", *[F.bit_xor(n).over(upto).alias(f"after{k}") for k, n in enumerate(names)],
        F.lead("level").over(order).isNull().alias("last"))

    def joined(columns: list) -> F.Column:
        return F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in columns]))

    after = [F.col(f"after{k}") for k in range(len(marks))]
    before = [a.bitwiseXOR(F.col(n)) for a, n in zip(after, names)]
    return slim.join(chain, ["conv_id", "level"]).select(
        "conv_id", "level", joined(before).alias("start"), "key", "lengths", joined(after).alias("next"), "last")


class _Block:
    """Nodes of the radix tree over one block of sorted, distinct keys."""

    def __init__(self, most: int):
        self.keys: list[tuple[bytes, tuple]] = []
        self.bytes, self.most = 0, most

    def add(self, start: bytes, key: bytes, value: tuple) -> None:
        self.keys.append((start + key, value))
        self.bytes += len(key) + 200

    def full(self) -> bool:
        return len(self.keys) >= self.most or self.bytes >= BLOCK_BYTES

    def nodes(self) -> Iterator[tuple]:
        """Rows of NODE, children before parents."""
        tree = RadixTree()
        for key, value in self.keys:
            tree.insert(key, (key, *value))
        edges = (self.keys[0][0], self.keys[-1][0])
        rows: list[list] = []
        found: dict[int, tuple] = {}
        for node, begin, end in tree.upwards():
            # members, least id, closed children, leaves and savings below, any key below
            count, least, closed, leaves, saved, some = 0, None, 0, 0, 0, None
            waiting: list[int] = []
            for _, child in node.below():
                c = found.pop(id(child))
                count += c[0]
                least = c[1] if least is None else min(least, c[1])
                closed, leaves, saved, some = closed + c[2], leaves + c[3], saved + c[4], c[5]
                waiting += c[6]
            following = None
            if node.value is not None:
                key, n, low, lengths, kids, under, more, link = node.value
                count, least = count + n, low if least is None else min(least, low)
                closed, leaves, saved, some = closed + kids, leaves + under, saved + more, (key, lengths)
                following = link
            # only the depths between two turns are nodes
            for turn in range((end - START) // ID, max(begin - START, -1) // ID, -1):
                depth = START + turn * ID
                length = some[1][turn - 1] if turn else 0
                key = some[0][:depth]
                is_open = any(e.startswith(key) for e in edges)
                own = [turn, least, count, closed, leaves, saved, None, None, None, None, length,
                       key[:START], following if depth == end else None]
                if is_open:
                    name = _digest(key)
                    own[7], own[9] = name, [_digest(key[:d]) for d in range(START, depth, ID)]
                    own[8] = own[9][-1] if own[9] else None
                else:
                    own[4] = leaves if closed else 1
                    own[5] = saved + (count - 1) * length
                for k in waiting:                    # children that wait to learn of their parent
                    rows[k][6] = None if is_open else least
                    rows[k][8] = _digest(key) if is_open else None
                rows.append(own)
                if is_open:                          # open nodes are added up by themselves
                    closed, leaves, saved, waiting = 0, 0, 0, []
                else:
                    closed, leaves, saved, waiting = 1, own[4], own[5], [len(rows) - 1]
            found[id(node)] = (count, least, closed, leaves, saved, some, waiting)
        return iter(rows)


def _digest(key: bytes) -> bytes:
    return hashlib.md5(key).digest()


_ARROW = pa.schema([("depth", pa.int32())] + [(c, pa.int64()) for c in _COLUMNS[1:5]]
                   + [("saved_tokens", pa.decimal128(38, 0)), ("parent_conv_id", pa.int64()), ("open", pa.binary()),
                      ("parent_open", pa.binary()), ("above", pa.list_(pa.binary())), ("length", pa.int64()),
                      ("start", pa.binary()), ("next", pa.binary())])


def _trees(block_keys: int):
    def emit(block: _Block) -> Iterator[pa.RecordBatch]:
        rows = list(block.nodes())
        for a in range(0, len(rows), 20_000):
            columns = list(zip(*rows[a:a + 20_000]))
            columns[5] = [Decimal(v) for v in columns[5]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(block_keys)
        for batch in batches:
            for r in batch.to_pylist():
                block.add(r["start"], r["key"], (r["n"], r["low"], r["lengths"], r["kids"], r["leaves"],
                                                 int(r["saved"]), r["next"]))
                if block.full():
                    yield from emit(block)
                    block = _Block(block_keys)
        if block.keys:
            yield from emit(block)
        return_memory()
    return trees


def _level(keys: DataFrame, block_keys: int) -> DataFrame:
    """Nodes of one level of segments, whole: NODE without the columns of open ones."""
    ordered = keys.repartitionByRange("start", "key").sortWithinPartitions("start", "key")
    parts = written(ordered.mapInArrow(_trees(block_keys), NODE), "trees")
    merged = written(parts.where("open is not null").groupBy("open").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("closed"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").cast("decimal(38,0)").alias("saved"),
        *[F.any_value(c, ignoreNulls=True).alias(c) for c in ("depth", "parent_open", "above", "length", "start", "next")]),
        "open-nodes")
    children = merged.groupBy(F.col("parent_open").alias("open")).agg(F.count(F.lit(1)).alias("opened"))
    merged = written(merged.join(children.where("open is not null"), "open", "left").withColumn(
        "n_children", F.col("closed") + F.coalesce("opened", F.lit(0))), "open-nodes")
    own = (F.col("n_convs") - 1).cast("decimal(20,0)") * F.col("length")
    totals = (merged.select(F.explode(F.concat(F.coalesce("above", F.array().cast("array<binary>")), F.array("open"))).alias("open"),
                            (F.col("leaves") + (F.col("n_children") == 0).cast("long")).alias("leaves"),
                            (F.col("saved") + own).alias("saved"))
              .groupBy("open").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").cast("decimal(38,0)").alias("saved_tokens")))
    kept = ["depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "parent_conv_id", "start", "next"]
    opened = merged.join(totals, "open")
    names = written(merged.select(F.col("open").alias("parent_open"), F.col("conv_id").alias("upper")), "open-names")
    opened = opened.join(names, "parent_open", "left").withColumn("parent_conv_id", F.col("upper")).select(*kept)
    closed = parts.where("open is null")
    inner = closed.where("parent_open is null").select(*kept)
    border = attach(closed.where("parent_open is not null"), names, ["parent_open"]).withColumn(
        "parent_conv_id", F.col("upper")).select(*kept)
    return opened.unionByName(inner).unionByName(border)


def _end_hashes(ends: DataFrame) -> DataFrame:
    """next, ends_sha256: SHA-256 of the ids of the conversations (next, conv_id), in order and comma-joined.

    Ids are sorted in ranges, so that a group of any size is spread; each task joins runs of ids, and the hash
    of a group reads its runs one after the other.
    """
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ids = batch.column("next").to_pylist(), batch.column("conv_id").to_pylist()
            cuts = [0, *[k for k in range(1, len(names)) if names[k] != names[k - 1]], len(names)]
            spans = [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[a] for a, _ in spans], pa.binary()), pa.array([ids[a] for a, _ in spans], pa.int64()),
                 pa.array([",".join(map(str, ids[a:b])) for a, b in spans], pa.large_string()).cast(pa.string())],
                ["next", "first", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            done = []
            for upcoming, text in zip(batch.column("next").to_pylist(), batch.column("ids").to_pylist()):
                if upcoming == name:
                    state.update(b"," + text.encode())
                    continue
                if name is not None:
                    done.append((name, state.hexdigest()))
                name, state = upcoming, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()),
                                              pa.array([d[1] for d in done], pa.string())], ["next", "ends_sha256"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()], pa.string())],
                                             ["next", "ends_sha256"])

    joined = (ends.repartitionByRange("next", "conv_id").sortWithinPartitions("next", "conv_id")
              .mapInArrow(runs, "next binary, first long, ids string"))
    return (joined.repartition("next").sortWithinPartitions("next", "first")
            .mapInArrow(hashes, "next binary, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, segment: int = SEGMENT, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are read as in `numbered_turns` and put together as in `rebuilt`. A node is a distinct
    sequence of first turns; the root has none and also holds the conversations without turns. Rows that
    repeat a turn are turns of their own. An empty table has no nodes.
    """
    convs, turns = rebuilt(numbered_turns(conversations))
    parts = written(segments(convs, turns, segment), "keys")
    # copies are counted before anything is sorted
    keys = written(parts.groupBy("level", "start", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"), F.any_value("lengths").alias("lengths"),
        F.any_value("next").alias("next")), "distinct-keys")
    deepest = keys.agg(F.max("level")).first()[0]
    if deepest is None:
        return conversations.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, "
                                                          "n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    nodes, under = None, None
    for level in range(deepest, -1, -1):
        own = keys.where(F.col("level") == level)
        if under is None:
            own = own.withColumn("kids", F.lit(0).cast("long")).withColumn("leaves", F.lit(0).cast("long")).withColumn(
                "saved", F.lit(0).cast("decimal(38,0)"))
        else:
            own = own.join(under, "next", "left").na.fill(0, ["kids", "leaves"]).withColumn(
                "saved", F.coalesce("saved", F.lit(0).cast("decimal(38,0)")))
        found = written(_level(own, block_keys).withColumn("depth", F.col("depth") + level * segment), "level")
        # the root of a lower segment is the last node of the segment above
        top = found.where(F.col("depth") == level * segment)
        under = top.select(F.col("start").alias("next"), F.col("n_children").alias("kids"), F.col("n_leaves").alias("leaves"),
                           F.col("saved_tokens").alias("saved"))
        found = found if level == 0 else found.where(F.col("depth") > level * segment)
        nodes = found if nodes is None else nodes.unionByName(found)
    nodes = written(nodes, "nodes")
    first = ((F.col("depth") - 1) % segment == 0) & (F.col("depth") > segment)
    above = nodes.where("next is not null").select(F.col("next").alias("start"), F.col("conv_id").alias("upper"))
    linked = nodes.where(first).join(above, "start", "left").withColumn("parent_conv_id", F.col("upper")).drop("upper")
    nodes = nodes.where(~first).unionByName(linked)
    hashes = written(_end_hashes(parts.where("last").select("next", "conv_id")), "ends")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    ended = nodes.where("next is not null").join(hashes, "next", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", none))
    inner = nodes.where("next is null").withColumn("ends_sha256", none)
    return ended.unionByName(inner.select(*ended.columns)).select(
        "conv_id", F.col("depth").cast("long"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved_tokens").cast("long"), "ends_sha256")
