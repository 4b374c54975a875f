"""SimHash near-duplicates: band buckets compared bit-sliced, then connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import as_bytes, blocks, checkpointed, components, connected, gathered, width

SEED = 42
WORDS = 4
RADIUS = 4
#: Rows of a bucket above which it is split again by the bits that remain: within its task, and before the shuffle.
LARGE, HOT = 4096, 1 << 15
#: Cells (query, word of 64 lanes) held at once by the bit-sliced comparison.
CELLS = 1 << 15
#: Parts over which the rows of one class are dealt when they get their class id.
SALTS = 32


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Bits set in over half the XXH64 of the text's word shingles; A-Z are lower-cased, no word gives 0."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = (ends[: len(found) - words + 1] - np.fromiter(map(len, found[: len(found) - words + 1]), np.int64) - 1).tolist()
    hashes = np.array([xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist())], "<u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(id, fingerprint as a signed long) of every row; null text has no words."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            data, at = as_bytes(block.column(1))
            raw = data.tobytes()
            made = np.array([fingerprint(raw[s:e], words, seed) for s, e in zip(at[:-1].tolist(), at[1:].tolist())], np.uint64)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(made.view(np.int64))], names=["id", "fingerprint"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fingerprint long")


def split_bits(bits: list[int], blocks_: int) -> list[list[int]]:
    cuts = np.linspace(0, len(bits), blocks_ + 1).round().astype(int)
    return [bits[a:b] for a, b in zip(cuts, cuts[1:])]


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def keys_of(bits: list[int], radius: int, blocks_: int | None = None) -> list[int]:
    """Masks of bits such that two values that differ in at most `radius` of these bits agree under at least one.

    Of `blocks_` blocks of the bits (radius + 2 unless more are wanted) all but `radius` agree at least.
    """
    parts = split_bits(bits, blocks_ or radius + 2)
    return [mask_of(sum(some, [])) for some in combinations(parts, len(parts) - radius)]


def blocks_for(n: int, radius: int) -> int:
    """The fewest blocks whose keys leave at most a quarter of LARGE of n evenly spread values in a bucket."""
    blocks_ = radius + 2
    while blocks_ < 64 and n > (LARGE // 4) << (64 * (blocks_ - radius) // blocks_):
        blocks_ += 1
    return blocks_


def within(planes: np.ndarray, values: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, lane) pairs at most `radius` bits apart, for CELLS cells at a time; query k looks at lanes low[k] to high[k].

    planes[b] holds bit b of 64 lanes a word. For each cell (query, word) the differing bits are added plane by
    plane into a counter whose bits lie in as many words as the radius needs, with the carries saved from word to
    word; one more word holds lanes that overflowed or are not the query's. Every eighth plane the cells whose
    lanes all exceed the radius are abandoned.
    """
    full, one = ~np.uint64(0), np.uint64(1)
    first, last = low >> 6, np.maximum(high - 1, low) >> 6
    wide = np.where(high > low, last - first + 1, 0)
    ends = np.cumsum(wide)
    for at in range(0, int(ends[-1]) if len(ends) else 0, CELLS):
        cell = np.arange(at, min(at + CELLS, int(ends[-1])))
        query = np.searchsorted(ends, cell, side="right")
        word = first[query] + cell - (ends[query] - wide[query])
        mine = np.full(len(cell), full)
        head, tail = word == first[query], word == last[query]
        mine[head] = full << (low[query[head]] & 63).astype(np.uint64)
        mine[tail] &= full >> (63 - (high[query[tail]] - 1 & 63)).astype(np.uint64)
        over, some = ~mine, values[query]
        count = [np.zeros(len(cell), np.uint64) for _ in range(max(1, int(radius).bit_length()))]
        for b in range(len(planes)):
            x = planes[b][word] ^ (np.uint64(0) - ((some >> np.uint64(b)) & one))
            for c in count:
                carry = c & x
                c ^= x
                x = carry
            over |= x
            if b % 8 == 7:
                alive = over | _exceeds(count, radius) != full
                if not alive.all():
                    query, word, over, some = query[alive], word[alive], over[alive], some[alive]
                    count = [c[alive] for c in count]
                    if not len(query):
                        break
        if not len(query):
            continue
        near = ~(over | _exceeds(count, radius))
        hit = np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cell, lane = np.nonzero(hit)
        yield query[cell], word[cell] * 64 + lane


def _exceeds(count: list[np.ndarray], limit: int) -> np.ndarray:
    """Lanes whose count, the lowest bit first, is over limit."""
    more, equal = np.zeros_like(count[0]), np.full_like(count[0], ~np.uint64(0))
    for k in reversed(range(len(count))):
        if limit >> k & 1:
            equal &= count[k]
        else:
            more |= equal & count[k]
            equal &= ~count[k]
    return more


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all values, 64 to a word. Lanes past the end repeat the last value."""
    n = -(-len(values) // 64) * 64
    padded = np.concatenate([values, np.full(n - len(values), values[-1], np.uint64)])
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8").astype(np.uint64)


def split_again(left: list[int], radius: int) -> bool:
    """Whether a large bucket whose values may differ in the bits `left` can be dealt out by them once more."""
    return len(left) >= 2 * (radius + 2)


def in_runs(values: np.ndarray, cut: np.ndarray, shared: np.ndarray, radius: int) -> np.ndarray:
    """For runs of distinct values (cut: their bounds), the smallest index of its run that each value reaches within it
    over links of at most `radius` differing bits, all by the bit-sliced comparison.

    shared: the mask of the bits known to be equal in each run. A run over LARGE is dealt out by the other bits:
    values within the radius agree under one mask of these at least, so every link lies in some part.
    """
    size = np.diff(cut)
    n, label = len(values), np.arange(len(values))
    high = np.repeat(cut[1:], size)
    left = [[b for b in range(64) if not int(m) >> b & 1] if s > LARGE else [] for m, s in zip(shared, size)]
    large = np.array([split_again(x, radius) for x in left], bool) if len(size) else np.zeros(0, bool)
    low = np.arange(1, n + 1)
    query = np.flatnonzero((low < high) & ~np.repeat(large, size))
    if len(query):
        for q, lane in within(planes_of(values), values[query], low[query], high[query], radius):
            label = components(n, np.concatenate([np.arange(n), query[q]]), np.concatenate([label, lane]))
    for k in np.flatnonzero(large):
        at = np.arange(cut[k], cut[k + 1])
        own, a, b = values[at], [np.arange(len(at))], [np.arange(len(at))]
        for mask in keys_of(left[k], radius):
            key = own & np.uint64(mask)
            order = np.argsort(key, kind="stable")
            inner = np.concatenate(([0], np.flatnonzero(np.diff(key[order])) + 1, [len(at)]))
            found = in_runs(own[order], inner, np.full(len(inner) - 1, int(shared[k]) | mask, np.uint64), radius)
            a.append(order)
            b.append(order[found])
        label[at] = at[components(len(at), np.concatenate(a), np.concatenate(b))]
    return label


def linked(values: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The smallest index reachable from each of distinct values over links of at most `radius` differing bits."""
    return in_runs(values, np.array([0, len(values)]), np.zeros(1, np.uint64), radius)


def bucket_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that span each bucket's components; rows (mask, key, value) arrive with buckets together."""

    def links(mask: np.ndarray, key: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.concatenate(([0], np.flatnonzero((np.diff(mask) != 0) | (np.diff(key) != 0)) + 1, [len(key)]))
        label = in_runs(value, cut, mask[cut[:-1]].view(np.uint64), radius)
        i = np.flatnonzero(label != np.arange(len(label)))
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(value[i].view(np.int64)), pa.array(value[label[i]].view(np.int64))], names=["a", "b"])

    for mask, key, value in whole_groups(batches, 2):
        yield from links(mask, key, value.view(np.uint64))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The numeric columns of batches whose rows come with equal values of the first `keys` columns together, cut so that no such group is split."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
        if held and all(held[0][i][0] == new[i][-1] for i in range(keys)):
            held.append(new)
            continue
        rows = [np.concatenate(x) for x in zip(*held, new)] if held else new
        other = np.zeros(len(rows[0]), bool)
        for x in rows[:keys]:
            other |= x != x[-1]
        last = len(other) - int(np.argmax(other[::-1])) if other.any() else 0
        if last:
            yield tuple(x[:last] for x in rows)
        held = [[x[last:] for x in rows]]
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def dealt_by(values: DataFrame, masks: list[int]) -> DataFrame:
    """(mask, key, fingerprint): each value once for each mask of bits, under the bits that the mask leaves of it."""
    every = F.array(*(F.lit(signed(m)) for m in masks))
    return values.select(F.explode(every).alias("mask"), "fingerprint").select("mask", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("key"), "fingerprint")


def links_of(values: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that span the components of distinct fingerprints within `radius` differing bits.

    Buckets of over HOT values are not sent to one task: their values are dealt out again by the bits that they may
    still differ in, until few enough are left in each or no bits are (then a bucket holds few values by nature).
    """
    n = values.count()
    masks = keys_of(list(range(64)), radius, blocks_for(n, radius))
    level, out, rows = dealt_by(values, masks), None, n * len(masks)
    while True:
        hot = checkpointed(gathered(level.groupBy("mask", "key").count().where(F.col("count") > HOT).select("mask", "key"), rows // HOT))
        masks = [r.mask & (1 << 64) - 1 for r in hot.select("mask").distinct().collect()]  # one for each set of blocks
        left = {m: [b for b in range(64) if not m >> b & 1] for m in masks}
        again = {m: keys_of(x, radius) for m, x in left.items() if split_again(x, radius)}
        hot = hot.where(F.col("mask").isin([signed(m) for m in again])) if again else None
        cold = level.join(hot, ["mask", "key"], "left_anti") if again else level
        dealt = cold.repartition(width(values.sparkSession), "mask", "key").sortWithinPartitions("mask", "key")
        found = dealt.mapInArrow(lambda batches: bucket_links(batches, radius), "a long, b long")
        out = found if out is None else out.union(found)
        if not again:
            return out
        more = [dealt_by(level.where(F.col("mask") == signed(m)).join(hot, ["mask", "key"], "left_semi"), [m | k for k in keys]) for m, keys in again.items()]
        level = more[0]
        for x in more[1:]:
            level = level.union(x)
        level = checkpointed(level)
        rows = level.count()


def named(values: DataFrame, links: DataFrame, node: str, rows: int, most: int) -> DataFrame:
    """(node, component_id) of values (node, low), so many rows: the smallest low of all nodes reachable over the links (a, b), `most` at most.

    Only linked nodes meet their class's minimum, each class in SALTS parts, so a class of any size spreads over tasks.
    """
    star = connected(links, most).select(F.col("node").alias("of"), "root")
    star = star.union(star.select("root", F.col("root").alias("also")).distinct())  # a root is a node of its class
    held = checkpointed(gathered(values.join(star, F.col(node) == F.col("of")).select(node, "low", "root", F.pmod(F.xxhash64(node), F.lit(SALTS)).alias("salt")), rows))
    least = held.groupBy("root").agg(F.min("low").alias("component_id")).select("root", "component_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    found = held.join(least, ["root", "salt"]).select(F.col(node).alias("of"), "component_id", F.lit(True).alias("known"))
    return values.join(found, F.col(node) == F.col("of"), "left").select(node, F.when(F.col("known"), F.col("component_id")).otherwise(F.col("low")).alias("component_id"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """The class of near-duplicates of every row: fingerprints link at `radius` or fewer differing bits.

    Each distinct fingerprint goes into a bucket for every choice of as many blocks of its bits as agree at least; by the
    pigeonhole principle each link lies in one bucket at least. A bucket is compared bit-sliced and gives links that
    span its components instead of all its pairs. component_id is the smallest id reachable, the row's own included.

    Null and empty texts have fingerprint 0 and link like any other; texts of any length are read whole; a null id names
    no class, so rows that link to no row with an id have a null component_id; repeated rows keep their rows; an
    empty table gives none. Other columns are ignored, whatever their names. Returns id, fingerprint (long), component_id.
    """
    rows = checkpointed(gathered(fingerprints(df, id_col, text_col, words, seed), df.count()))
    values = checkpointed(gathered(rows.groupBy("fingerprint").agg(F.min("id").alias("low")), rows.count()))
    n = values.count()
    most = n * len(keys_of(list(range(64)), radius, blocks_for(n, radius)))  # a bucket gives fewer links than it has values
    classes = checkpointed(gathered(named(values, links_of(values, radius), "fingerprint", n, most), n))  # so that the join has plain exchanges, whose large partitions Spark splits
    return rows.join(classes, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "component_id")
