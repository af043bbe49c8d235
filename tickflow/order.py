"""Ordered scans without unbounded window partitions.

Rows are ordered by (``part``, ``pos``), a day and a unique row number inside the day.
One day may hold a large share of all rows, so a window over a whole day is never used.
Instead every day is cut into blocks of ``block_rows`` consecutive positions:

* short look-backs (lag n, rolling k) run per block, after the last n rows of each block
  were copied into the next one (``with_halo``; needs gap-free positions);
* unbounded scans (running sum, forward fill, previous row) run per block and add a
  carry, computed on a table with one row per block;
* group-wise values reduce to one row per (block, group) first.

A block holds at most ``block_rows`` rows whatever the distribution of days, runs or
updates, so no task ever receives a hot group. The block table is smaller than the data
by a factor of ``block_rows``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickflow.runtime import BROADCAST_ROWS, attach, sized, written


@dataclass(frozen=True)
class Order:
    part: str = "date_trd"
    pos: str = "trd_id"
    block_rows: int = 1 << 18
    broadcast_rows: int = BROADCAST_ROWS

    @property
    def keys(self) -> list[str]:
        return [self.part, "_blk"]

    def block(self) -> Column:
        return F.expr(f"`{self.pos}` div {self.block_rows}")

    def tag(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_blk", self.block())

    def rows(self):
        """Rows of one block in order."""
        return W.partitionBy(*self.keys).orderBy(self.pos)

    def blocks(self, *, within_part: bool):
        """Blocks in order; for the block table only."""
        if within_part:
            return W.partitionBy(self.part).orderBy("_blk")
        return W.orderBy(self.part, "_blk")


DAY_ORDER = Order()


def require_gap_free(df: DataFrame, order: Order = DAY_ORDER) -> None:
    """Fail when a day's positions have gaps or repeat; look-backs count positions.

    Per block the number of positions, and the exclusive-or of their hashes, must be those of the whole
    range between the day's first and last position, so a gap and a repeat cannot make up for each other.
    """
    own = order.tag(df.select(order.part, order.pos)).groupBy(*order.keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(order.pos).alias("lo"), F.max(order.pos).alias("hi"),
        F.bit_xor(F.xxhash64(F.col(order.pos).cast("long"))).alias("mark"))
    own = written(own, "positions")                        # one row per block
    day = W.partitionBy(order.part)
    edges = own.withColumn("first", F.min("lo").over(day)).withColumn("last", F.max("hi").over(day)).withColumn(
        "blocks", F.count(F.lit(1)).over(day))
    begin = F.greatest("first", F.col("_blk") * order.block_rows)
    end = F.least("last", (F.col("_blk") + 1) * order.block_rows - 1)
    listed = edges.select(*order.keys, "n", "mark", F.explode(F.sequence(begin.cast("long"), end.cast("long"))).alias("p"))
    wrong = (listed.groupBy(*order.keys, "n", "mark")
             .agg(F.count(F.lit(1)).alias("span"), F.bit_xor(F.xxhash64("p")).alias("ideal"))
             .where("n <> span or mark <> ideal").select(*order.keys, "n", "span"))
    missing = edges.where(F.col("blocks") != F.expr(f"`last` div {order.block_rows} - `first` div {order.block_rows} + 1")
                          ).select(*order.keys, "n", F.lit(0).cast("long").alias("span"))
    broken = wrong.unionByName(missing).head()
    if broken is not None:
        raise ValueError(
            f"{order.pos} of {order.part} {broken[order.part]} has gaps or repeats "
            f"(block {broken['_blk']}: {broken['n']} rows); renumber with dense_position")


def with_halo(df: DataFrame, n: int, order: Order = DAY_ORDER) -> DataFrame:
    """Copy the last ``n`` rows of each block into the following block.

    The caller evaluates windows over ``order.rows()`` and then calls ``drop_halo``.
    """
    if n > order.block_rows:
        raise ValueError(f"look-back of {n} rows exceeds the block of {order.block_rows}")
    in_tail = F.col(order.pos) % order.block_rows >= order.block_rows - n
    targets = F.when(in_tail, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))
    return df.withColumn("_own", order.block()).withColumn("_blk", F.explode(targets))


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where("_blk = _own").drop("_blk", "_own")


def previous_row(df: DataFrame, cols: Sequence[str], order: Order = DAY_ORDER,
                 prefix: str = "prev_", across_parts: bool = True) -> DataFrame:
    """Value of the preceding row of the whole frame (or of the day)."""
    tagged = order.tag(df)
    last = (tagged.groupBy(*order.keys)
            .agg(F.max_by(F.struct(*cols), order.pos).alias("_last")))
    carry = last.select(
        *order.keys, F.lag("_last").over(order.blocks(within_part=not across_parts)).alias("_carry"))
    joined = attach(tagged, carry, order.keys, max_rows=order.broadcast_rows)
    first_in_block = F.row_number().over(order.rows()) == 1
    return joined.select(
        *df.columns,
        *[F.when(first_in_block, F.col("_carry")[c])
          .otherwise(F.lag(c).over(order.rows())).alias(prefix + c) for c in cols])


def forward_fill(df: DataFrame, col: str, out: str, order: Order = DAY_ORDER) -> DataFrame:
    """Last non-null value up to each row, across days."""
    tagged = order.tag(df)
    last = (tagged.groupBy(*order.keys)
            .agg(F.max_by(col, F.when(F.col(col).isNotNull(), F.col(order.pos))).alias("_last")))
    before = order.blocks(within_part=False).rowsBetween(W.unboundedPreceding, -1)
    carry = last.select(*order.keys, F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    joined = attach(tagged, carry, order.keys, max_rows=order.broadcast_rows)
    seen = F.last(col, ignorenulls=True).over(order.rows().rowsBetween(W.unboundedPreceding, 0))
    return joined.withColumn(out, F.coalesce(seen, F.col("_carry"))).drop("_blk", "_carry")


def backward_fill(df: DataFrame, cols: Sequence[str], order: Order) -> DataFrame:
    """First non-null value from each row on, inside the day.

    Read backwards, so that the frames grow from the start of the window: a frame that ends
    at the last row would be evaluated anew for every row.
    """
    tagged = order.tag(df)
    first = tagged.groupBy(*order.keys).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order.pos))).alias(c) for c in cols])
    later_blocks = (W.partitionBy(order.part).orderBy(F.desc("_blk"))
                    .rowsBetween(W.unboundedPreceding, -1))
    carry = first.select(
        *order.keys,
        *[F.last(c, ignorenulls=True).over(later_blocks).alias(f"_carry_{c}") for c in cols])
    joined = attach(tagged, carry, order.keys, max_rows=order.broadcast_rows)
    later_rows = (W.partitionBy(*order.keys).orderBy(F.desc(order.pos))
                  .rowsBetween(W.unboundedPreceding, 0))
    kept = [c for c in df.columns if c not in cols]
    return joined.select(
        *kept,
        *[F.coalesce(F.last(c, ignorenulls=True).over(later_rows), F.col(f"_carry_{c}")).alias(c)
          for c in cols])


def running_sum(df: DataFrame, col: str, out: str, order: Order = DAY_ORDER) -> DataFrame:
    """Inclusive running sum inside the day."""
    tagged = order.tag(df)
    total = tagged.groupBy(*order.keys).agg(F.sum(col).alias("_total"))
    before = order.blocks(within_part=True).rowsBetween(W.unboundedPreceding, -1)
    carry = total.select(*order.keys, F.sum("_total").over(before).alias("_carry"))
    joined = attach(tagged, carry, order.keys, max_rows=order.broadcast_rows)
    inside = F.sum(col).over(order.rows().rowsBetween(W.unboundedPreceding, 0))
    return joined.withColumn(out, inside + F.coalesce("_carry", F.lit(0))).drop("_blk", "_carry")


def running_group_max(df: DataFrame, group: str, col: str, out: str,
                      order: Order = DAY_ORDER) -> DataFrame:
    """Inclusive running maximum of ``col`` inside (day, group).

    Only groups that an earlier block has seen get a carry, so its table holds those that cross a block's edge.
    """
    tagged = order.tag(df)
    top = tagged.groupBy(*order.keys, group).agg(F.max(col).alias("_top"))
    before = W.partitionBy(order.part, group).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    carry = top.select(*order.keys, group, F.max("_top").over(before).alias("_carry")).where("_carry is not null")
    joined = attach(tagged, carry, [*order.keys, group], max_rows=order.broadcast_rows)
    inside = F.max(col).over(
        W.partitionBy(*order.keys, group).orderBy(order.pos).rowsBetween(W.unboundedPreceding, 0))
    return (joined.withColumn(out, F.greatest(inside, F.col("_carry")))
            .drop("_blk", "_carry"))


def group_edges(df: DataFrame, group: str, *, last: dict[str, str] | None = None,
                order: Order = DAY_ORDER) -> DataFrame:
    """Last non-null value of each (day, group) on all its rows; ``last`` maps out -> col."""
    last = last or {}
    tagged = order.tag(df)
    per_block = tagged.groupBy(*order.keys, group).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order.pos))).alias(out)
          for out, c in last.items()])
    whole = (W.partitionBy(order.part, group).orderBy("_blk")
             .rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    total = per_block.select(
        *order.keys, group, *[F.last(o, ignorenulls=True).over(whole).alias(o) for o in last])
    return attach(tagged, total, [*order.keys, group], max_rows=order.broadcast_rows).drop("_blk")


def lookup(df: DataFrame, table: DataFrame, on: list[str], order: Order = DAY_ORDER) -> DataFrame:
    """Left join on keys of which one may hold a large share of the rows.

    A table of checked size is broadcast. Beyond that the table is first spread to the
    distinct (block, key) pairs, so the final join key holds at most one block of rows.
    """
    stored, small = sized(table, order.broadcast_rows)
    if small:
        return df.join(F.broadcast(stored), on, "left")
    tagged = order.tag(df)
    extra = [c for c in order.keys if c not in on]
    pairs = tagged.select(*on, *extra).distinct().join(stored, on, "left")
    return tagged.join(pairs, [*on, *extra], "left").drop("_blk")


def global_index(df: DataFrame, out: str, order: Order = DAY_ORDER) -> DataFrame:
    """Gap-free 0-based row number over the whole frame."""
    tagged = order.tag(df)
    counts = tagged.groupBy(*order.keys).agg(F.count(F.lit(1)).alias("_n"))
    before = order.blocks(within_part=False).rowsBetween(W.unboundedPreceding, -1)
    carry = counts.select(*order.keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carry"))
    joined = attach(tagged, carry, order.keys, max_rows=order.broadcast_rows)
    index = F.col("_carry") + F.row_number().over(order.rows()) - 1
    return joined.withColumn(out, index).drop("_blk", "_carry")


def keys_at(df: DataFrame, ranks: dict[object, list[int]], group: str | None = None,
            order: Order = DAY_ORDER) -> dict[tuple[object, int], tuple]:
    """(part, pos) of the rows at the given 0-based ranks of the ordered frame, per group.

    Needs one count per block and then reads only the blocks that hold a wanted rank;
    rows are not shuffled. The result has one entry per wanted rank.
    """
    spark = df.sparkSession
    group_col = F.col(group) if group else F.lit(0)
    tagged = order.tag(df).withColumn("_grp", group_col)
    counts = tagged.groupBy("_grp", *order.keys).agg(F.count(F.lit(1)).alias("_n"))
    ordered = W.partitionBy("_grp").orderBy(*order.keys)
    spans = counts.withColumn("_end", F.sum("_n").over(ordered))
    wanted = [(g, r) for g, rs in ranks.items() for r in rs]
    if not wanted:
        return {}
    wish = spark.createDataFrame(
        wanted, schema=f"_grp {dict(tagged.dtypes)['_grp']}, _rank long")
    holders = (spans.join(F.broadcast(wish), "_grp")
               .where((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_n")))
               .select("_grp", *order.keys, "_rank",
                       (F.col("_rank") - F.col("_end") + F.col("_n") + 1).alias("_nth")))
    # one row per wanted rank
    hits = (tagged.join(F.broadcast(holders.groupBy("_grp", *order.keys)
                                    .agg(F.collect_list(F.struct("_nth", "_rank")).alias("_want"))),
                        ["_grp", *order.keys])
            .withColumn("_rn", F.row_number().over(
                W.partitionBy("_grp", *order.keys).orderBy(order.pos)))
            .select("_grp", order.part, order.pos, "_rn", F.explode("_want").alias("_w"))
            .where("_rn = _w._nth")
            .select("_grp", F.col("_w._rank").alias("_rank"), order.part, order.pos))
    return {(r["_grp"], r["_rank"]): (r[order.part], r[order.pos]) for r in hits.collect()}


def before_key(key: tuple, order: Order = DAY_ORDER) -> Column:
    """Rows ordered strictly before ``key`` = (part, pos)."""
    part, pos = F.lit(key[0]), F.lit(key[1])
    return (F.col(order.part) < part) | ((F.col(order.part) == part) & (F.col(order.pos) < pos))


def ranged(df: DataFrame, *cols: str, partitions: int | None = None) -> DataFrame:
    """Range-partition by ``cols``, add the partition number ``_rp`` and write.

    Ranges are sampled, so they stay even for any distribution of distinct keys; writing
    fixes ``_rp`` for later scans.
    """
    args = ([partitions] if partitions else []) + list(cols)
    return written(df.repartitionByRange(*args).withColumn("_rp", F.spark_partition_id()), "ranged")


def cumulative(df: DataFrame, by: Sequence[str], value: str, measures: Sequence[str],
               partitions: int | None = None, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Adds ``before_<m>``: sum of ``m`` over rows of the same ``by`` with a smaller ``value``.

    (``by``, ``value``) must be unique; group equal values before calling.
    """
    parts = ranged(df, *by, value, partitions=partitions)
    totals = parts.groupBy(*by, "_rp").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    before = W.partitionBy(*by).orderBy("_rp").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        *by, "_rp", *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_c_{m}") for m in measures])
    joined = attach(parts, carry, [*by, "_rp"], max_rows=max_rows)
    inside = W.partitionBy(*by, "_rp").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return joined.select(
        *df.columns,
        *[(F.col(f"_c_{m}") + F.coalesce(F.sum(m).over(inside), F.lit(0))).alias(f"before_{m}")
          for m in measures])


def dense_position(df: DataFrame, part: str, by: Sequence[str], out: str,
                   partitions: int | None = None) -> DataFrame:
    """0-based gap-free row number inside ``part`` in the order of ``by`` (unique)."""
    parts = ranged(df, part, *by, partitions=partitions)
    counts = parts.groupBy(part, "_rp").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(part).orderBy("_rp").rowsBetween(W.unboundedPreceding, -1)
    carry = counts.select(part, "_rp", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carry"))
    joined = attach(parts, carry, [part, "_rp"])
    index = F.col("_carry") + F.row_number().over(W.partitionBy(part, "_rp").orderBy(*by)) - 1
    return joined.withColumn(out, index).drop("_rp", "_carry")
