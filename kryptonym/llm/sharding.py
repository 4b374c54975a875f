"""Minimax contiguous sharding: the smallest feasible capacity over ordered atomic groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, width

#: Atomic groups: classes of the text's hash, in the order of their number. Equal texts share one.
GROUPS = 1 << 16


def feasible(sums: np.ndarray, shards: int, capacity: int) -> list[int] | None:
    """Ends of the shards (group indexes, exclusive) that greedy filling up to capacity makes, or None if they are too many."""
    ends, at, n = [], 0, len(sums) - 1
    while at < n:
        to = int(np.searchsorted(sums, sums[at] + capacity, side="right")) - 1
        if to == at or len(ends) == shards:
            return None
        ends.append(to)
        at = to
    return ends + [n] * (shards - len(ends))


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """(smallest capacity, ends of the shards) of the contiguous partition whose largest shard is smallest.

    Greedy filling leaves the last shard short, so each cut then moves back to the group nearest to its even
    share, as far as the capacity of this shard and of those behind it allows: no shard exceeds the minimum.
    """
    sums = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    n, total = len(sizes), int(sums[-1])
    low, high = max(-(-total // shards), int(sizes.max(initial=0))), total
    while low < high:
        middle = (low + high) // 2
        if feasible(sums, shards, middle) is None:
            low = middle + 1
        else:
            high = middle
    back = [n]
    for _ in range(shards - 1):
        back.append(int(np.searchsorted(sums, sums[back[-1]] - low, side="left")))
    earliest, ends, at = back[::-1], [], 0
    for k in range(1, shards):
        farthest = int(np.searchsorted(sums, sums[at] + low, side="right")) - 1
        even = total * k / shards
        near = int(np.searchsorted(sums, even))
        if near > 0 and even - sums[near - 1] <= sums[near] - even:
            near -= 1
        at = max(at, min(farthest, max(earliest[k - 1], near)))
        ends.append(at)
    return low, [*ends, n]


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, groups: int = GROUPS) -> DataFrame:
    """Put every row into one of `shards` shards of near equal bytes; rows of equal text stay together.

    A row's size is its text's UTF-8 bytes plus 8. Texts fall into `groups` classes of their hash, the atomic
    groups; only their summed sizes reach the driver, at most `groups` numbers whatever the input. The capacity
    is the smallest for which filling shards in order succeeds: the optimum over these classes. An optimum over single
    texts' groups could be better by less than the largest class, as every shard stays within its even share and one class. Slots number a shard's rows without gaps in the
    order (group, id): a range partitioning deals them out, so a group with many copies spreads over tasks.

    Null text: size 8, as empty, in the same group. Repeated rows each get a slot. Empty table: no rows. Other
    columns of the input are ignored, whatever their names; a text of any length counts whole; of equal ids the order follows the hash. Returns id, size, text_crc32, shard, slot, shard_group.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = checkpointed(df.select(F.col(id_col).alias("_id"), (F.octet_length(text).cast("long") + 8).alias("_size"), F.crc32(text.cast("binary")).alias("_crc"), F.pmod(F.xxhash64(text), F.lit(groups)).cast("int").alias("_group")))
    found = rows.groupBy("_group").agg(F.sum("_size").alias("bytes"), F.count("*").alias("rows")).collect()
    size, count = np.zeros(groups, np.int64), np.zeros(groups, np.int64)
    for g, b, n in found:
        size[g], count[g] = b, n
    _, ends = minimax_cuts(size, shards)
    before = np.concatenate(([0], np.cumsum(count)))
    starts = [0, *ends[:-1]]
    number = sum((F.when(F.col("_group") >= e, 1).otherwise(0) for e in ends[:-1]), F.lit(0))
    first = F.element_at(F.array(*(F.lit(int(before[s])) for s in starts)), F.col("_shard") + 1)
    dealt = rows.repartitionByRange(width(spark), "_group", "_id").sortWithinPartitions("_group", "_id", "_crc")
    dealt = checkpointed(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    held = sorted((p, n) for p, n in dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    at, offsets = 0, []
    for p, n in held:
        offsets.append((int(p), at))
        at += n
    base = spark.createDataFrame(offsets, "_part long, _base long")  # a row for each partition
    out = dealt.withColumn("_part", part).join(F.broadcast(base), "_part").withColumn("_shard", number)
    place = F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) - first
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_shard").alias("shard"), place.alias("slot"), F.col("_group").alias("shard_group"))
