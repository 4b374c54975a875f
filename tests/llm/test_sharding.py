import itertools

import numpy as np
import pytest

from kryptonym.llm import queries, sharding


def brute(sizes, shards):
    n = len(sizes)
    best = sum(sizes)
    for cuts in itertools.combinations_with_replacement(range(n + 1), shards - 1):
        edges = [0, *cuts, n]
        best = min(best, max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:])))
    return best


@pytest.mark.parametrize("seed", range(20))
def test_capacity_is_smallest(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 30, int(rng.integers(1, 9)))
    shards = int(rng.integers(1, 5))
    capacity, ends = sharding.minimax_cuts(sizes, shards)
    assert capacity == brute(list(sizes), shards)
    edges = [0, *ends]
    assert len(ends) == shards and ends[-1] == len(sizes) and all(a <= b for a, b in zip(edges, edges[1:]))
    assert max(sizes[a:b].sum() for a, b in zip(edges, edges[1:])) <= capacity


def test_even_cuts():
    _, ends = sharding.minimax_cuts(np.ones(1000, np.int64), 24)
    assert set(np.diff([0, *ends])) == {41, 42}


def checked(rows, shards):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))


def test_rows(spark):
    data = [(i, "same text" if i % 3 else f"text {i} " * (i % 7)) for i in range(300)] + [(5, None), (5, None), (None, ""), (1007, "é"), (1008, "x" * 50_000)]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as size", "'a' as shard", "doc_id as _id", "0 as slot")
    out = sharding.shard(df, shards=5).collect()
    assert len(out) == len(data)
    checked(out, 5)
    assert len({r.shard for r in out if r.text_crc32 == out_crc("same text")}) == 1
    by_id = {r.doc_id: r for r in out}
    assert by_id[1007].size == 10 and by_id[1008].size == 50_008 and by_id[None].size == 8 and by_id[None].text_crc32 == 0
    assert sharding.shard(df.limit(0), shards=5).count() == 0


def out_crc(text):
    import zlib

    return zlib.crc32(text.encode())


def test_query(spark, sf):
    out = queries.QUERIES["op4_sharding"](spark, sf).collect()
    checked(out, 24)
    sizes = np.bincount([r.shard for r in out], [r.size for r in out], 24)
    groups = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        groups[r.text] = groups.get(r.text, 0) + len((r.text or "").encode()) + 8
    classes = np.bincount([r.shard_group for r in sharding.shard(spark.read.parquet(f"{sf}/documents.parquet")).collect()], [r.size for r in out])
    assert sizes.max() <= -(-sizes.sum() // 24) + max(max(groups.values()), int(classes.max()))
    assert len(out) == 200 and sizes.max() <= sizes.sum() / 24 + max(r.size for r in out) * 2
