"""Document fingerprints by consistent weighted sampling of weighted words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, as_bytes, blocks, prepare, width, word_spans

SAMPLES = 128
#: Rows of the tables of random variables. A word draws (r, beta) and c from rows that two parts of its hash name.
ROWS = 1 << 13
#: Weighted words sampled at once: their values stay in a core's cache.
STEP = 1 << 10


class Sampler:
    """Ioffe's consistent weighted sampling: for each sample k a weighted word (x, w) has
    t = floor(ln w / r + beta) and ln a = ln c - r (t - beta + 1), with r, c ~ Gamma(2, 1) and beta uniform by (x, k);
    the word of the smallest a is the sample. Two texts share the sample (x, t) with the probability of their
    generalised Jaccard similarity. The value of a stands for (x, t): 16 bits of it are the signature."""

    def __init__(self, samples: int = SAMPLES, seed: int = 5):
        rng = np.random.default_rng(seed)
        shape = (ROWS, samples)
        self.r = rng.gamma(2, 1, shape).astype(np.float32)
        self.beta = rng.random(shape, np.float32)
        self.c = np.log(rng.gamma(2, 1, shape)).astype(np.float32)
        self.once = self.r * (self.beta - 1)  # the part of ln a besides ln c at weight 1, where t = 0
        self.samples = samples

    def of(self, array: pa.Array) -> np.ndarray:
        """(texts, samples) uint16. A text's words, lower-cased, weigh as often as they occur; no word: all 65535."""
        data, at = as_bytes(pc.utf8_lower(array))
        starts, ends, row = word_spans(data, at)
        out = np.full((len(array), self.samples), 0xFFFF, np.uint16)
        if not len(starts):
            return out
        key = RollingHash(data).of(starts, ends) >> np.uint64(20) | row.astype(np.uint64) << np.uint64(44)
        key, weight = np.unique(key, return_counts=True)
        row = (key >> np.uint64(44)).astype(np.int64)
        one, two = (key & np.uint64(ROWS - 1)).astype(np.int64), (key >> np.uint64(20) & np.uint64(ROWS - 1)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(row)) + 1))
        low = np.empty((len(first), self.samples), np.float32)
        a = 0
        while a < len(first):
            b = max(a + 1, int(np.searchsorted(first, first[a] + STEP)))
            low[a:b] = self._least(one, two, weight, first, a, b, len(key))
            a = b
        bits = low.view(np.uint32)
        out[row[first]] = (bits ^ bits >> np.uint32(15)).astype(np.uint16) % np.uint16(0xFFFF)
        return out

    def _least(self, one, two, weight, first, a: int, b: int, n: int) -> np.ndarray:
        s, e = int(first[a]), int(first[b]) if b < len(first) else n
        if b == a + 1 and e - s > STEP:  # one long text
            parts = [self._values(one[i : i + STEP], two[i : i + STEP], weight[i : min(e, i + STEP)], e - i).min(0) for i in range(s, e, STEP)]
            return np.min(parts, axis=0)[None]
        return np.minimum.reduceat(self._values(one[s:e], two[s:e], weight[s:e], e - s), first[a:b] - s, axis=0)

    def _values(self, one, two, weight, most: int) -> np.ndarray:
        one, two, weight = one[:most], two[:most], weight[:most]
        value = self.once[one]
        more = np.flatnonzero(weight > 1)
        if len(more):
            r, beta = self.r[one[more]], self.beta[one[more]]
            t = np.floor(np.log(weight[more].astype(np.float32))[:, None] / r + beta)
            value[more] = -r * (t - beta + 1)
        value += self.c[two]
        return value


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row: the estimate of the generalised Jaccard similarity."""
    return (a == b).mean(1) if len(a) else np.zeros(0)


def hexed(signatures: np.ndarray) -> pa.Array:
    return pa.array([s.tobytes().hex() for s in signatures.astype(">u2")], pa.string())


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """id and fingerprint (4 hex digits a sample) of every row, in one pass without a shuffle.

    Null and empty texts share the fingerprint of no word. Repeated rows each get theirs; an empty table
    gives none; other columns are ignored.
    """
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for block in blocks(batches):
            yield pa.RecordBatch.from_arrays([block.column(0), hexed(sampler.of(block.column(1)))], names=["id", "fingerprint"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fingerprint string")
    return out.select(F.col("id").alias(id_col), "fingerprint")


#: The order of rows: (id, hash of the text); a null id comes first.
LOWEST = -(1 << 63)


def places(bounds: list[tuple[int, int]], ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """How many of the ascending bounds (id, hash) are at most each (id, hash)."""
    of, second = (np.array([x[k] for x in bounds], np.int64) for k in (0, 1))
    low, high = np.searchsorted(of, ids, "left"), np.searchsorted(of, ids, "right")
    for at in np.unique(low[high > low]):
        same = np.flatnonzero((low == at) & (high > low))
        low[same] = at + np.searchsorted(second[at : high[same[0]]], hashes[same], "right")
    return low


def in_order(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, extra): rows dealt by ranges of (id, hash of the text) and sorted, each range followed by a copy
    (extra = 1) of the row that comes next in the whole order; the first row follows the last.

    Spark's own range partitioning of the ids and hashes gives the ranges; of each only its first row's id and hash reach
    the driver. They go to the workers as one array, so the plan does not grow with the ranges.
    """
    spark = df.sparkSession
    n = width(spark)
    own = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = own.select("id", "text", F.coalesce("id", F.lit(LOWEST)).alias("k"), F.xxhash64("text").alias("h"))
    ranges = keyed.select("k", "h").repartitionByRange(n, "k", "h").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("k", "h")).alias("first"))
    firsts = sorted((r.first.k, r.first.h) for r in ranges.select("first").collect())
    sent = spark.sparkContext.broadcast(firsts)

    def bucket(k: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(places(sent.value, k.to_numpy(), h.to_numpy()) - 1, 0))

    def before(k: pd.Series, h: pd.Series) -> pd.Series:
        """The range that the row follows as a copy, -1 if the row is not the first of its own."""
        at = np.maximum(places(sent.value, k.to_numpy(), h.to_numpy()) - 1, 0)
        mine = np.array(sent.value, np.int64).reshape(-1, 2)[at] if len(at) else np.zeros((0, 2), np.int64)
        return pd.Series(np.where((mine[:, 0] == k.to_numpy()) & (mine[:, 1] == h.to_numpy()), (at - 1) % len(sent.value), -1))

    of = lambda f: F.pandas_udf(f, "long")("k", "h")
    copies = keyed.withColumn("bucket", of(before)).where("bucket >= 0").groupBy("k", "h", "bucket").agg(F.min("text").alias("text"))
    copies = copies.select(F.nullif("k", F.lit(LOWEST)).alias("id"), "text", "k", "h", F.lit(1).alias("extra"), "bucket")
    dealt = keyed.select("id", "text", "k", "h", F.lit(0).alias("extra"), of(bucket).alias("bucket")).union(copies)
    spread = dealt.repartitionById(max(n, len(firsts)), F.col("bucket").cast("int"))
    return spread.sortWithinPartitions("extra", "k", "h", "text").select("id", "text", "extra")


def with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next text's.

    The edited text has its last floor(n / 2) code points replaced by the first as many, or all, of the next
    row's text in the order of (id, hash of the text); the first row follows the last. Ids are whole numbers; a null id
    comes first, repeated ids in the order of their texts' hashes. Null text is empty; texts of any length are read whole; two
    texts without a word are fully alike. A single row is its own next; an empty table gives none. Other columns are
    ignored, whatever their names.
    """
    prepare(df.sparkSession)
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        last = None  # (id, text, its signature): the row whose next one is awaited
        for block in blocks(batches):
            ids, texts, extra = (block.column(i).to_pylist() for i in range(3))
            own = sampler.of(block.column(1))
            if last is not None:
                ids, texts, extra, own = [last[0], *ids], [last[1], *texts], [0, *extra], np.concatenate([last[2], own])
            ready = sum(1 for x in extra[:-1] if not x)
            if ready:
                edited = []
                for text, after in zip(texts[:ready], texts[1 : ready + 1]):
                    half = len(text) // 2
                    edited.append(text[: len(text) - half] + after[:half])
                both = pa.array(edited, pa.string())
                made = np.concatenate([sampler.of(b.column(0)) for b in blocks(iter([pa.RecordBatch.from_arrays([both], names=["text"])]))])
                hashed = [hashlib.sha256(x.encode()).hexdigest() for x in edited]
                near, next_ = likeness(own[:ready], made), likeness(own[:ready], own[1 : ready + 1])
                yield pa.RecordBatch.from_arrays([pa.array(ids[:ready], pa.int64()), pa.array([len(t) for t in texts[:ready]], pa.int64()), pa.array(hashed), hexed(own[:ready]), hexed(made), pa.array(near), pa.array(next_)], names=names)
            last = None if extra[-1] else (ids[-1], texts[-1], own[-1:])

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = in_order(df, id_col, text_col).mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), *names[1:])
