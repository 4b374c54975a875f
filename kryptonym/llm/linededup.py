"""Line dedup: sharded cuckoo filters in front of exact reference-count tables, kept in a store that takes documents in and out."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from .common import as_bytes, blocks, checkpoint_dir, checkpointed, gathered, width

STRIPPED = b" \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3
#: Repeated keys of a shard, at most about; there are as many shards as tasks of a shuffle, more for more keys.
SHARD_KEYS = 1 << 15
#: A key that holds at least so large a part of all references is looked up before the shuffle: there are no more than this many.
HOT_KEYS = 4096
#: Keys in one file of the exact table.
PART_ROWS = 200_000
SLOTS = 4
KICKS = 500


class CuckooFilter:
    """Set of 128-bit keys as 16-bit tags, four to a bucket, in one of two buckets; deletions are exact for inserted keys."""

    def __init__(self, capacity: int = 64, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(1, int(np.ceil(np.log2(max(capacity, 1) / (SLOTS * 0.85)))))
            table = np.zeros((buckets, SLOTS), np.uint16)
        self.table = table

    @staticmethod
    def _parts(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """keys: (n, 2) uint64. Tags (never 0) and the two buckets; each bucket follows from the other and the tag."""
        tag = (keys[:, 1] >> np.uint64(48)).astype(np.uint16)
        tag[tag == 0] = 1
        first = (keys[:, 1] & np.uint64(buckets - 1)).astype(np.int64)
        return tag, first, first ^ CuckooFilter._jump(tag, buckets)

    @staticmethod
    def _jump(tag, buckets: int):
        return ((tag.astype(np.int64) * 0x5BD1E995) >> 8) & (buckets - 1) | 1 if buckets > 1 else tag.astype(np.int64) * 0

    def _turn(self, at: np.ndarray, held: np.ndarray, put: np.ndarray) -> np.ndarray:
        """For each k, a slot of its own in bucket at[k] that holds held[k] gets put[k]; False where there is none."""
        order = np.lexsort((held, at))
        a, h = at[order], held[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (h[1:] != h[:-1])
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        match = self.table[a] == h[:, None]
        ok = rank < match.sum(1)
        slot = np.argsort(~match, axis=1, kind="stable")[np.arange(len(order)), np.minimum(rank, SLOTS - 1)]
        self.table[a[ok], slot[ok]] = put[order][ok]
        out = np.zeros(len(order), bool)
        out[order] = ok
        return out

    def insert(self, keys: np.ndarray) -> bool:
        """False if some key found no place: the caller builds a larger filter from the exact table."""
        tag, i, j = self._parts(keys, len(self.table))
        left = ~self._turn(i, np.zeros_like(tag), tag)
        tag, j = tag[left], j[left]
        left = ~self._turn(j, np.zeros_like(tag), tag)
        rng, rows = np.random.default_rng(len(self.table)), self.table
        for t, a in zip(tag[left], j[left]):
            for _ in range(KICKS):
                free = np.flatnonzero(rows[a] == 0)
                if len(free):
                    rows[a, free[0]] = t
                    break
                slot = rng.integers(SLOTS)
                t, rows[a, slot] = rows[a, slot], t
                a = a ^ int(self._jump(np.uint16(t), len(rows)))
            else:
                return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        tag, i, j = self._parts(keys, len(self.table))
        left = ~self._turn(i, tag, np.zeros_like(tag))
        self._turn(j[left], tag[left], np.zeros_like(tag[left]))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        tag, i, j = self._parts(keys, len(self.table))
        return (self.table[i] == tag[:, None]).any(1) | (self.table[j] == tag[:, None]).any(1)

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        room = max(len(keys), 8)
        while not (made := cls(room)).insert(keys):
            room *= 2
        return made

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())


def halves(keys: pa.Array) -> np.ndarray:
    """(n, 2) numbers of an array of 16-byte keys."""
    return as_bytes(keys)[0].view("<u8").reshape(-1, 2).astype(np.uint64)


def key_of(line: bytes, min_chars: int) -> bytes | None:
    """The 128-bit key of a line that counts, None for one too short."""
    line = line.strip(STRIPPED)
    if len(line) < min_chars or len(line) < 4 * min_chars and len(line.decode("utf-8", "replace")) < min_chars:
        return None
    return xxh3_128_digest(line.lower())


def postings(df: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, key): each counting line of each row once."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            data, at = as_bytes(block.column(1))
            raw, row, keys = data.tobytes(), [], []
            for k, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                found = {key_of(x, min_chars) for x in raw[s:e].split(b"\n")} - {None}
                keys += found
                row += [k] * len(found)
            if keys:
                yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(row)), pa.array(keys, pa.binary())], names=["id", "key"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, key binary")


def without_lines(df: DataFrame, lost: DataFrame, id_col: str, text_col: str, min_chars: int, counted: bool = True) -> DataFrame:
    """The rows of df without the lines of the lost keys (id, keys); if `counted`, with n_lines and n_dropped."""
    added = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    fields = [f for f in df.schema if not counted or f.name not in ("n_lines", "n_dropped")]
    fields = [T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in fields]
    names = [f.name for f in fields]
    inner = [f"c{i}" for i in range(len(names))]
    at_text = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, inner[at_text]):
            data, at = as_bytes(block.column(at_text))
            raw, texts, n_lines, n_dropped = data.tobytes(), [], [], []
            for s, e, keys in zip(at[:-1].tolist(), at[1:].tolist(), block.column(len(inner)).to_pylist()):
                text = raw[s:e]
                if not keys:
                    texts.append(text)
                    n_lines.append(text.count(b"\n") + 1)
                    n_dropped.append(0)
                    continue
                gone, lines = set(keys), text.split(b"\n")
                kept = [x for x in lines if key_of(x, min_chars) not in gone]
                texts.append(b"\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            columns = [block.column(i) for i in range(len(inner))]
            columns[at_text] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*inner, "n_lines", "n_dropped"])

    own = df.select(*(F.col(n).cast("string").alias(c) if n == text_col else F.col(n).alias(c) for n, c in zip(names, inner)))
    at_id = inner[names.index(id_col)]
    joined = own.join(lost.select(F.col("id").alias("lost_id"), "keys").hint("shuffle_hash"), F.col(at_id).eqNullSafe(F.col("lost_id")), "left")
    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(inner, fields)] + added)
    out = joined.select(*inner, "keys").mapInArrow(run, schema)
    return out.select(*(F.col(c).alias(n) for n, c in zip(names, inner)), *(["n_lines", "n_dropped"] if counted else []))


class LineStore:
    """Incremental, reversible line dedup in a shared folder that any later process can open again.

    Each batch is a version n: `refs/n` holds (id, key, delta), +1 for each line that documents brought, -1 for each that a
    deletion took back; `counts/n` the exact table (key, n_docs, last_id) of all keys alive; `filters/n` a cuckoo filter of
    the repeated keys of every shard. `manifest/n`, written last, names the parts of a version: a batch that
    dies before it leaves the version before it in force and is simply run again. A deletion undoes an insertion
    exactly: counts and the largest id are those of the documents that remain. Keys enter and leave a shard's filter
    one by one; a full filter is built anew at twice the size from the exact table, and when shards have grown to
    twice SHARD_KEYS, all are dealt out anew. Every COMPACTED batches the references are added up into one part.
    """

    COMPACTED = 16

    def __init__(self, spark: SparkSession, path: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS):
        self.spark, self.path = spark, path.rstrip("/")
        self.state = self._newest() or {"version": 0, "shards": 1, "refs": [], "counts": None, "filters": None, "min_chars": min_chars, "min_docs": min_docs}
        if (self.state["min_chars"], self.state["min_docs"]) != (min_chars, min_docs):
            raise ValueError("the store was made with other settings")
        self.min_chars, self.min_docs = min_chars, min_docs

    def _newest(self) -> dict | None:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return None
        done = [s.getPath() for s in fs.listStatus(root) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        if not done:
            return None
        newest = max(done, key=lambda p: int(p.getName()))
        return json.loads(self.spark.read.text(newest.toString()).first()[0])

    def _write(self, df: DataFrame, part: str, version: int) -> str:
        path = f"{self.path}/{part}/{version}"
        df.write.mode("overwrite").parquet(path)
        return path

    def refs(self) -> DataFrame:
        """(id, key, delta) of all batches."""
        return self.spark.read.parquet(*self.state["refs"])

    def counts(self) -> DataFrame:
        """The exact table: key, n_docs, last_id."""
        return self.spark.read.parquet(self.state["counts"])

    def heavy(self, counts: DataFrame | None = None) -> DataFrame:
        """The repeated keys; a line of rows without an id only is none."""
        counts = self.counts() if counts is None else counts
        return counts.where((F.col("n_docs") >= self.min_docs) & F.col("last_id").isNotNull())

    @staticmethod
    def _shard(shards: int):
        return F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")

    def _commit(self, delta: DataFrame, brought: bool) -> None:
        old, n = self.state, self.state["version"] + 1
        refs = [*old["refs"], self._write(delta, "refs", n)]
        new = self.spark.read.parquet(refs[-1])
        alive = lambda d: d.groupBy("key", "id").agg(F.sum("delta").alias("n")).where("n > 0").groupBy("key").agg(F.sum("n").alias("n_docs"), F.max("id").alias("last_id"))
        if not old["counts"]:
            counts = new.groupBy("key").agg(F.sum("delta").alias("n_docs"), F.max("id").alias("last_id"))
        elif brought:
            more = new.groupBy("key").agg(F.sum("delta").alias("n_docs"), F.max("id").alias("last_id"))
            counts = self.counts().union(more).groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("last_id").alias("last_id"))
        else:
            touched = new.select("key").distinct()
            again = alive(self.spark.read.parquet(*refs).join(touched, "key", "left_semi"))
            counts = self.counts().join(touched, "key", "left_anti").union(again)
        rows = new.count() + (self.counts().count() if old["counts"] else 0)
        path = self._write(gathered(counts, rows, PART_ROWS), "counts", n)
        counts = self.spark.read.parquet(path)
        keys, shards = self.heavy(counts).count(), old["shards"]
        if not old["counts"] or keys > 2 * shards * SHARD_KEYS:
            shards = max(shards, width(self.spark), -(-keys // SHARD_KEYS))
        filters = self._write(self._filters(counts, shards, shards == old["shards"] and bool(old["counts"])), "filters", n)
        if len(refs) > self.COMPACTED:
            refs = [self._write(self.spark.read.parquet(*refs).groupBy("id", "key").agg(F.sum("delta").cast("int").alias("delta")).where("delta > 0"), "refs-compacted", n)]
        state = old | {"version": n, "shards": shards, "refs": refs, "counts": path, "filters": filters}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/{n}")
        self.state = state

    def _filters(self, counts: DataFrame, shards: int, held: bool) -> DataFrame:
        """(shard, filter) of the repeated keys. Of a version with the same shards only the keys that changed enter or leave."""
        now = self.heavy(counts).select("key", self._shard(shards), F.lit(0).alias("sign"))
        if not held:
            rows, before = now, self.spark.createDataFrame([], "shard long, filter binary")
        else:
            was = self.heavy().select("key", self._shard(shards))
            gone = was.join(now, "key", "left_anti").select("key", "shard", F.lit(-1).alias("sign"))
            come = now.join(was, "key", "left_anti").select("key", "shard", F.lit(1).alias("sign"))
            rows, before = now.union(gone).union(come), self.spark.read.parquet(self.state["filters"])
        both = rows.select("shard", "key", "sign", F.lit(None).cast("binary").alias("filter")).union(before.select("shard", F.lit(None).cast("binary"), F.lit(2), "filter"))

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, tuple[dict[int, list], list]] = {}
            for batch in batches:
                shard, sign = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                for s in np.unique(shard).tolist():
                    keys, filters = found.setdefault(s, ({-1: [], 0: [], 1: []}, []))
                    for x in keys:
                        keys[x].append(batch.column(1).filter(pa.array((shard == s) & (sign == x))))
                    filters += batch.column(3).filter(pa.array((shard == s) & (sign == 2))).to_pylist()
            for s, (keys, filters) in found.items():
                gone, all_, come = (halves(pa.concat_arrays(keys[x])) for x in (-1, 0, 1))
                made = CuckooFilter.from_bytes(filters[0]) if filters else None
                if made is not None:
                    made.delete(gone)
                if made is None or not made.insert(come):
                    made = CuckooFilter.of(all_)
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([made.to_bytes()], pa.binary())], names=["shard", "filter"])

        return both.repartition(min(shards, 16 * width(self.spark)), "shard").mapInArrow(build, "shard long, filter binary")

    def insert(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Documents come in; a row whose id is there already counts besides."""
        self._commit(postings(df, id_col, text_col, self.min_chars).withColumn("delta", F.lit(1)), True)

    def delete(self, ids: DataFrame) -> None:
        """ids: one column, the documents that go, with all their rows; ids that aren't there change nothing."""
        gone = ids.select(F.col(ids.columns[0]).alias("gone")).distinct()
        alive = self.refs().groupBy("id", "key").agg(F.sum("delta").alias("n")).where("n > 0")
        self._commit(alive.join(gone, F.col("id").eqNullSafe(F.col("gone")), "left_semi").select("id", "key", (-F.col("n")).cast("int").alias("delta")), False)

    def lost(self, found: DataFrame) -> DataFrame:
        """(id, keys): which of the lines (id, key) are repeated and not in their last document.

        Keys with a HOT_KEYS-th of all references are at most HOT_KEYS; they are sent to every worker. All other lines
        meet their shard in one task: its filter first, and its part of the exact table for what the filter lets through.
        """
        kind = found.schema["id"].dataType.simpleString()
        total = self.counts().agg(F.sum("n_docs")).first()[0] or 0
        heavy = self.heavy()
        hot = heavy.where(F.col("n_docs") * HOT_KEYS >= total).select("key", F.col("last_id").alias("last"))
        marked = found.join(F.broadcast(hot), "key", "left")
        of_hot = marked.where(F.col("last").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("last")))).select("id", "key")
        shard, nothing = self._shard(self.state["shards"]), F.lit(None)
        filters = self.spark.read.parquet(self.state["filters"]).select("shard", F.lit(0).alias("what"), nothing.cast(kind).alias("id"), F.col("filter").alias("key"))
        exact = heavy.where(F.col("n_docs") * HOT_KEYS < total).select(shard, F.lit(1).alias("what"), F.col("last_id").cast(kind).alias("id"), "key")
        lines = marked.where(F.col("last").isNull()).select(shard, F.lit(2).alias("what"), "id", "key")
        dealt = filters.union(exact).union(lines).repartitionById(width(self.spark), F.col("shard").cast("int")).sortWithinPartitions("shard", "what")

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, filter_, last = None, None, {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                shard, what = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                cut = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (what[1:] != what[:-1])) + 1).tolist(), len(shard)]
                for s, e in zip(cut, cut[1:]):
                    part = batch.slice(s, e - s)
                    if shard[s] != now:
                        now, filter_, last = shard[s], None, {}
                    if what[s] == 0:
                        filter_ = CuckooFilter.from_bytes(part.column(3)[0].as_py())
                    elif what[s] == 1:
                        last |= zip(part.column(3).to_pylist(), part.column(2).to_pylist())
                    elif filter_ is not None:
                        some = np.flatnonzero(filter_.holds(halves(part.column(3))))
                        own = part.take(pa.array(some))
                        keep = [(x := last.get(k)) is not None and (i is None or i < x) for k, i in zip(own.column(3).to_pylist(), own.column(2).to_pylist())]
                        yield own.select([2, 3]).filter(pa.array(keep, pa.bool_()))

        rest = dealt.mapInArrow(probe, f"id {kind}, key binary")
        return of_hot.union(rest).groupBy("id").agg(F.collect_set("key").alias("keys"))

    def clean(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The documents without the lines that are repeated in the store; n_lines and n_dropped are added."""
        lost = self.lost(checkpointed(postings(df, id_col, text_col, self.min_chars)))
        return without_lines(df, lost, id_col, text_col, self.min_chars)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, path: str | None = None, counted: bool = True) -> DataFrame:
    """Drop lines whose key at least `min_docs` rows hold, except in the rows of the largest id that holds it.

    The rows go into a new LineStore (at `path`, or in the shared folder of checkpoints), which then cleans them; with
    a path, later batches and deletions can follow. A line's key is the line without white space at its ends, A-Z
    lower-cased; keys under `min_chars` code points never count. The exact table counts each key once per row.

    Null text is empty, which is one empty line; texts of any length are read whole. Repeated rows count as rows, and those
    of the largest id all keep their lines. A null id is smaller than any other. An empty table gives no rows.
    Columns of the input stay; if `counted`, n_lines and n_dropped are added in the place of any of these names.
    """
    spark = df.sparkSession
    store = LineStore(spark, path or f"{checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}", min_chars, min_docs)
    if store.state["version"]:
        raise ValueError("there is a store already: open it by LineStore")
    store.insert(df, id_col, text_col)
    return without_lines(df, store.lost(store.refs().select("id", "key")), id_col, text_col, min_chars, counted)
