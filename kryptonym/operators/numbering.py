"""Numbering rows within groups without a task for each group."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kryptonym.functions.columns import inner


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the folder in spark.checkpoint.dir; a local folder only where none is set in a local session, as in tests."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a shared folder")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "kryptonym-checkpoints"))
    return df.checkpoint()


#: A key with so large a part of all rows is joined by itself: there are no more than this many such keys.
HOT_KEYS = 4096


def joined_hot(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """The inner join of checkpointed rows with a table that has each key once, without a task for each key; no key is null.

    Keys with a HOT_KEYS-th of the rows are at most HOT_KEYS, so their part of the table is sent to every worker.
    """
    total = rows.count()
    hot = checkpointed(rows.groupBy(*on).agg(F.count("*").alias(inner(rows, "rows")[0])).where(F.col(inner(rows, "rows")[0]) * HOT_KEYS >= total).select(*on).join(table, on))
    return rows.join(F.broadcast(hot), on).union(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(table, on))


def numbered(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with n: 1, 2, ... within each group of `by` in the given order.

    The rows are dealt by ranges of (by, order) and sorted, so a large group spreads over tasks. A row's place is its
    place in its partition plus the rows of the partitions before; only those counts reach the driver.
    """
    spark = df.sparkSession
    at, part, base, place, start = inner(df, "_at", "_part", "_base", "_place", "_start")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
    dealt = checkpointed(dealt.withColumn(at, F.monotonically_increasing_id()))
    of = F.shiftright(at, 33)
    offsets, before = [], 0
    for p, n in sorted(tuple(r) for r in dealt.groupBy(of.alias("p")).agg(F.count("*")).collect()):
        offsets.append((int(p), before))
        before += n
    offsets = spark.createDataFrame(offsets, f"{part} long, {base} long")  # a row for each partition
    placed = dealt.withColumn(part, of).join(F.broadcast(offsets), part).withColumn(place, F.col(base) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
    if not by:
        return placed.withColumn("n", F.col(place) + 1).drop(at, part, base, place)
    placed = checkpointed(placed)
    starts = placed.groupBy(*by).agg(F.min(place).alias(start))
    return joined_hot(placed, starts, by).withColumn("n", F.col(place) - F.col(start) + 1).drop(at, part, base, place, start)
