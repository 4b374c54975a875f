"""What the operators share: tables, checkpoints, Arrow blocks, vectorised word hashing."""

from __future__ import annotations

import ctypes
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kryptonym.shipping import ship

#: Bytes of text handled by one vectorised step in a Python worker; a longer text is one step of its own.
BLOCK_BYTES = 1 << 19

#: Rows and bytes of one Arrow batch sent to a Python worker; a longer row is a batch of its own.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: Rows of a small table, such as the links of a round of connected components, in one file.
ROWS_OF_LINKS = 100_000


def prepare(spark: SparkSession) -> SparkSession:
    """Make this package importable on the executors and keep Arrow batches small."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where there is none and the session is a local one, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a shared folder")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "kryptonym-checkpoints"))
    return sc.getCheckpointDir()


def free_name(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder of checkpoints, without their lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def gathered(df: DataFrame, rows: int, each: int = ROWS_OF_LINKS) -> DataFrame:
    """The table, known to have so many rows at most, dealt into as few partitions as hold `each` of them: small tables make few
    files. All tasks still make it; joining them in one task instead would keep the memory of all their sorts."""
    return df.repartition(min(width(df.sparkSession), 1 + rows // each))


def release() -> None:
    """Give memory that a worker no longer uses back to the system: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about `most` bytes of the column; nulls there become empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        i = batch.schema.get_field_index(column)
        filled = pc.fill_null(batch.column(i), "")
        batch = batch.set_column(i, pa.field(column, filled.type), filled)
        ends = np.cumsum(pc.binary_length(filled).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def as_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all values, offsets of each value in them) of a string array without nulls."""
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


#: A key with so large a part of all rows is joined by itself: there are no more than this many such keys.
HOT_KEYS = 4096


def joined_hot(rows: DataFrame, table_: DataFrame, on: list[str]) -> DataFrame:
    """The inner join of checkpointed rows with a table that has each key once, without a task for each key.

    Keys with a HOT_KEYS-th of the rows are at most HOT_KEYS, so their part of the table is sent to every worker.
    """
    total = rows.count()
    hot = checkpointed(gathered(rows.groupBy(*on).count().where(F.col("count") * HOT_KEYS >= total).select(*on).join(table_, on), HOT_KEYS))
    some = F.broadcast(hot)
    return rows.join(some, on).union(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(table_, on))


def without(rows: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The rows but for those of checkpointed distinct ids; a row without an id stays. Few ids are sent to the workers instead of the rows being dealt."""
    return rows.join(F.broadcast(gone) if gone.count() <= FEW_IDS else gone, id_col, "left_anti")


#: Ids of which a set is sent to every worker.
FEW_IDS = 1 << 18

#: The white space that separates words: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, value's index) of every run of other bytes than `space`, in order; runs end where a value ends."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    gap = space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, gap[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, gap[1:]
    starts = np.flatnonzero(~gap & (before | edge[:-1]))
    ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, BLOCK_BYTES + 65536)
        made = []
        for base in (_BASE, _INVERSE):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        if m > 4 * BLOCK_BYTES:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


class RollingHash:
    """64-bit polynomial hashes of any byte ranges of one buffer, from one prefix sum modulo 2^64."""

    def __init__(self, data: np.ndarray):
        self.power, self.inverse = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def connected(edges: DataFrame, links: int | None = None) -> DataFrame:
    """(node, root) for every node of the links (a, b), longs: root is the smallest node reachable. links: how many there are at most, if known.

    Alternates the large-star and the small-star step; each round is checkpointed, and nothing but two
    numbers a round reaches the driver. A hub's links are reduced by a map-side minimum, which is checkpointed
    by itself: the joins with it then have a plain exchange on either side, whose large partitions Spark splits.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    if links is not None:
        e = gathered(e, links)
    e, last = checkpointed(e), None
    parts = min(width(e.sparkSession), 1 + e.count() // ROWS_OF_LINKS)  # a round makes no more links than it gets
    while True:
        both = e.union(e.select("b", "a"))
        low = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).repartition(parts))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = checkpointed(large.repartition(parts))
        low = checkpointed(large.groupBy("a").agg(F.min("b").alias("m")).repartition(parts))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = checkpointed(small.union(low.select("a", F.col("m").alias("b"))).distinct().repartition(parts))
        state = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == last:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = state
