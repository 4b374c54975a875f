"""Near-duplicates by shingle similarity: SimHash fingerprints compared bit-sliced within buckets, shingle sets decide exactly.

The settings of a corpus stage beside those of `simhash.near_duplicates`: at a similarity of 0.8 fingerprints differ in some ten
bits, so blocks of their bits give no buckets. Bands of minima of the same shingles' hashes do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FEW_IDS, RollingHash, as_bytes, blocks, checkpointed, connected, gathered, mixed, prepare, width, word_spans
from .simhash import named, planes_of, within

WORDS = 5
SIMILARITY = 0.8
#: A pair at similarity s shares no band with probability (1 - s^ROWS)^BANDS: 3e-5 at 0.8.
BANDS, ROWS = 20, 4
#: Differing bits up to which fingerprints may belong to similar texts: at 0.8 the mean is 9.7, the deviation 2.9.
RADIUS = 22
#: Texts of a bucket that one task compares with each other; a larger bucket is cut into parts of about so many.
PART = 512
#: Sketches, and shingle sets, in one file.
SKETCHES, SETS = 20_000, 5_000
#: Near pairs of a unit looked at together.
PAIRS = 1 << 15
SEED = 42

_random = np.random.default_rng(SEED)
_XOR, _TIMES = (_random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) for _ in range(2))
_TIMES = _TIMES * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets of each text in them): the distinct word shingles of each text, ascending.

    A-Z are lower-cased and white space does not count. A text of fewer words is one shingle, one of none has none.
    """
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    starts, ends, of = word_spans(low, offsets)
    texts = len(offsets) - 1
    count = np.bincount(of, minlength=texts)
    own = RollingHash(low).of(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    first = np.concatenate(([0], np.cumsum(count)))
    made = np.minimum(count, 1) + np.maximum(count - words, 0)
    row = np.repeat(np.arange(texts), made)
    at = first[row] + np.arange(len(row)) - (np.cumsum(made) - made)[row]
    out = np.zeros(len(row), np.uint64)
    for k in range(words):
        out = mixed(out + np.uint64(0x9E3779B97F4A7C15))
        inside = at + k < first[row + 1]
        out[inside] += own[at[inside] + k]
    out = mixed(out)
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[new], np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=texts))))


def whole(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One number for each set of shingles, 0 for the empty one."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)))))
    return mixed(sums[at[1:]] - sums[at[:-1]])


def band_keys(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, BANDS): a number of the ROWS minima of each band; texts without shingles have 0."""
    texts = len(at) - 1
    out = np.zeros((texts, BANDS), np.uint64)
    full = np.flatnonzero(at[1:] > at[:-1])
    if not len(full):
        return out
    begin = at[:-1][full]
    for b in range(BANDS):
        key = np.zeros(len(full), np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            key = mixed(key + np.minimum.reduceat((hashes ^ _XOR[k]) * _TIMES[k], begin))
        out[full, b] = key
    return out


def bits_of(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The SimHash fingerprint of each set of shingles: a bit is set where over half the hashes have it."""
    out = np.zeros(len(at) - 1, np.uint64)
    full = np.flatnonzero(at[1:] > at[:-1])
    size = np.diff(at)[full]
    for b in range(64):
        ones = np.add.reduceat((hashes >> np.uint64(b) & np.uint64(1)).astype(np.int64), at[:-1][full]) if len(full) else size
        out[full] |= (2 * ones > size).astype(np.uint64) << np.uint64(b)
    return out


def sketches(df: DataFrame, words: int) -> DataFrame:
    """(id, node: the number of its shingle set, fingerprint, keys of its bands) of rows (id, text)."""
    kind = df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            hashes, at = shingles(*as_bytes(block.column(1)), words)
            keys = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(hashes, at).view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(whole(hashes, at).view(np.int64)), pa.array(bits_of(hashes, at).view(np.int64)), keys], names=["id", "node", "bits", "keys"])

    return df.mapInArrow(run, f"id {kind}, node long, bits long, keys array<long>")


def shingle_sets(df: DataFrame, words: int) -> DataFrame:
    """(node, its sorted shingles as bytes) of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            hashes, at = shingles(*as_bytes(block.column(1)), words)
            held = [hashes[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(whole(hashes, at).view(np.int64)), pa.array(held, pa.binary())], names=["node", "held"])

    return df.mapInArrow(run, "node long, held binary")


def similar(one: np.ndarray, two: np.ndarray, similarity: float) -> bool:
    """Whether two ascending sets have at least the Jaccard similarity."""
    few, many = min(len(one), len(two)), max(len(one), len(two))
    if few < similarity * many:
        return False
    both = np.sort(np.concatenate((one, two)), kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return same >= similarity * (len(both) - same)


def unit_links(node: np.ndarray, bits: np.ndarray, keys: np.ndarray, band: int, side: np.ndarray, root: np.ndarray, held: list, similarity: float, radius: int) -> list[tuple[int, int]]:
    """Links of one unit that join texts of different classes (root), each verified on the sets, until none is left.

    side 0 and 1: only pairs of one with the other are compared; side 2: all with each other. A pair that shares an earlier
    band is left to that band's bucket.
    """
    order = np.lexsort((node, side))
    node, bits, keys, side, root = node[order], bits[order], keys[order], side[order], root[order]
    n, of = len(node), {}
    label = np.array([of.setdefault(r, k) for k, r in enumerate(root.tolist())])
    if label.max() == 0:
        return []
    split = int(np.searchsorted(side, 1)) if side[0] == 0 else n
    queries = np.arange(split) if side[0] == 0 else np.arange(n)
    low = np.full(len(queries), split) if side[0] == 0 else queries + 1
    out, size = [], np.array([len(held[k]) for k in order])

    def top(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    shared = np.ascontiguousarray(keys[:, :band].T)
    for q, lane in within(planes_of(bits), bits[queries], low, np.full(len(queries), n), radius):
        for k in range(0, len(q), PAIRS):
            a, b = queries[q[k : k + PAIRS]], lane[k : k + PAIRS]
            while not np.array_equal(label, label[label]):
                label = label[label]
            few, many = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
            use = (label[a] != label[b]) & (few >= similarity * many)
            a, b = a[use], b[use]
            for mark in shared:
                use = mark[a] != mark[b]
                a, b = a[use], b[use]
            for x, y in zip(a.tolist(), b.tolist()):
                one, two = top(x), top(y)
                if one != two and similar(np.frombuffer(held[order[x]], np.uint64), np.frombuffer(held[order[y]], np.uint64), similarity):
                    label[max(one, two)] = min(one, two)
                    out.append((int(node[x]), int(node[y])))
    return out


def links_in_units(rows: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Links (a, b) of rows (key, one, two: the unit; band, side, node, bits, keys, root, held), unit by unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unit = pa.Table.from_batches(parts).combine_chunks()
            numbers = [unit.column(c).to_numpy() for c in ("node", "side", "root")]
            bits = unit.column("bits").to_numpy().view(np.uint64)
            keys = unit.column("keys").chunk(0).flatten().to_numpy().reshape(len(bits), -1)
            held = unit.column("held").chunk(0)
            found = unit_links(numbers[0], bits, keys, unit.column("band")[0].as_py(), numbers[1], numbers[2], [x.as_buffer() for x in held], similarity, radius)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

        open_: list[pa.RecordBatch] = []
        name = None
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = [batch.column(i).to_numpy() for i in range(3)]
            new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in unit], axis=0)) + 1
            for s, e in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
                own = tuple(int(x[s]) for x in unit)
                if own != name and open_:
                    yield from done(open_)
                    open_ = []
                name = own
                open_.append(batch.slice(s, e - s))
        if open_:
            yield from done(open_)

    dealt = rows.select("key", "one", "two", "band", "side", "node", "bits", "keys", "root", "held")
    dealt = dealt.repartition(width(rows.sparkSession), "key", "one", "two").sortWithinPartitions("key", "one", "two")
    return dealt.mapInArrow(run, "a long, b long")


def part_of(node: str, size: Column) -> Column:
    """The part of a bucket of `size` texts that a text falls into; parts hold about PART."""
    return F.pmod(F.xxhash64(node), F.ceil(size / PART)).cast("long")


def across(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Units of large buckets that hold several classes: every pair of different classes meets in one.

    The bucket's largest class is M, all other texts are O. Parts of O meet each other and every part of M; M, which is one class,
    does not meet itself. So a bucket of one class, however large, gives no unit.
    """
    large = buckets.where(F.col("size") > PART).join(roots, buckets.node == roots.of, "left").withColumn("root", F.coalesce("root", "node")).drop("of")
    by_class = large.groupBy("key", "root").agg(F.count("*").alias("n"))
    most = by_class.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("all"), F.count("*").alias("classes")).where("classes > 1")
    held = large.join(most.select("key", F.col("m.root").alias("main"), F.col("m.n").alias("n_main"), (F.col("all") - F.col("m.n")).alias("n_other")), "key")
    is_main = F.col("root") == F.col("main")
    held = held.withColumn("part", F.when(is_main, part_of("node", F.col("n_main"))).otherwise(part_of("node", F.col("n_other"))))
    n_main, n_other = F.ceil(F.col("n_main") / PART).cast("long"), F.ceil(F.col("n_other") / PART).cast("long")
    each = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    unit = lambda one, two, side: F.struct(one.alias("one"), two.alias("two"), side.cast("long").alias("side"))
    # units of M are (part of O, -1 - part of M), units of O (lower part, higher part)
    of_main = F.transform(each(n_other), lambda o: unit(o, -1 - F.col("part"), F.lit(1)))
    with_main = F.transform(each(n_main), lambda m: unit(F.col("part"), -1 - m, F.lit(0)))
    inner = F.transform(each(n_other), lambda o: unit(F.least(o, F.col("part")), F.greatest(o, F.col("part")), F.when(o == F.col("part"), 2).when(o > F.col("part"), 0).otherwise(1)))
    units = F.when(is_main, of_main).otherwise(F.concat(with_main, inner))
    return held.withColumn("u", F.explode(units)).select("key", "u.one", "u.two", "u.side", "band", "node", "root")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The class of near-duplicates of every row: texts link where their distinct word shingles have the Jaccard similarity.

    Equal sets of shingles are one node, with one SimHash fingerprint. Nodes that share a band of minhashes fall into a bucket. A
    bucket's fingerprints are compared bit-sliced; each pair within the radius whose nodes are not linked yet is decided on
    the sets themselves. Buckets of up to PART nodes are compared whole. A larger one is cut into parts of about
    PART: first the nodes of each part are compared, then, once the classes so found are known, the parts of its other
    classes with each other and with those of its largest class. So every pair of a bucket is compared or in one class
    already, no pairs are written, and no comparison holds more than two parts. component_id is the smallest id reachable.

    Null and empty texts are one class; texts of any length are read whole; rows that link to no row with an id have a
    null component_id; repeated rows keep their rows; an empty table gives none. Other columns are ignored, whatever their
    names. Returns id, component_id.
    """
    prepare(df.sparkSession)
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = checkpointed(gathered(sketches(own, words), df.count(), SKETCHES))
    nodes = rows.groupBy("node").agg(F.min("id").alias("low"), F.first("bits").alias("bits"), F.first("keys").alias("keys"))
    nodes = checkpointed(gathered(nodes, rows.count(), SKETCHES))
    n = nodes.count()
    marks = nodes.where(F.exists("keys", lambda k: k != 0)).select("node", F.posexplode("keys").alias("band", "key")).select(F.xxhash64("band", "key").alias("key"), "band", "node")
    # of several bands whose buckets hold the same nodes the first is enough
    mark = F.xxhash64("node", F.lit(7))
    shared = marks.groupBy("key").agg(F.count("*").alias("size"), F.min("band").alias("of"), F.bit_xor(mark).alias("x"), F.sum(F.pmod(mark, F.lit(1 << 31))).alias("y")).where("size > 1")
    shared = shared.groupBy("size", "x", "y").agg(F.min(F.struct("of", "key")).alias("one")).select(F.col("one.key").alias("key"), "size")
    buckets = checkpointed(gathered(marks.join(shared, "key"), n * BANDS))
    needed = checkpointed(gathered(buckets.select("node").distinct(), n))
    some = F.broadcast(needed) if needed.count() <= FEW_IDS else needed
    sets = shingle_sets(own, words).join(some, "node", "left_semi").groupBy("node").agg(F.first("held").alias("held"))
    sets = checkpointed(gathered(sets.join(nodes.select("node", "bits", "keys"), "node"), needed.count(), SETS))
    first = buckets.select("key", part_of("node", F.col("size")).alias("one"), F.lit(0).cast("long").alias("two"), F.lit(2).cast("long").alias("side"), "band", "node", F.col("node").alias("root"))
    most = buckets.count()  # a unit gives fewer links than it has rows
    links = checkpointed(gathered(links_in_units(first.join(sets, "node"), similarity, radius).distinct(), most))
    if not buckets.where(F.col("size") > PART).isEmpty():
        roots = connected(links, most)
        roots = checkpointed(gathered(roots.union(roots.select("root", F.col("root").alias("also")).distinct()).select(F.col("node").alias("of"), "root"), n))
        links = links.union(links_in_units(across(buckets, roots).join(sets, "node"), similarity, radius))
    classes = checkpointed(gathered(named(nodes.select("node", "low"), links, "node", n, 2 * most), n))
    return rows.join(classes, "node").select(F.col("id").alias(id_col), "component_id")
