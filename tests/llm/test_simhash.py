import re

import numpy as np
import pytest
import xxhash

from kryptonym.llm import queries, simhash
from kryptonym.llm.common import components, connected


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius=4):
    v = np.array(values, np.uint64)
    a, b = np.nonzero(np.bitwise_count(v[:, None] ^ v) <= radius)
    return components(len(v), a, b)


TEXTS = ["", None, " \n", "One", "one", "ONE two", "a b c d", "A  b\nc\td", "a b c d e", "É b c d é", "x " * 3000, "k k k k k k k", "w\x0bq\x0cz"]


@pytest.mark.parametrize("text", TEXTS + [" ".join(f"w{i * i % 97}" for i in range(400))])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)


def family(rng, n, seeds):
    out = set()
    roots = [int(x) for x in rng.integers(0, 1 << 63, seeds)]
    while len(out) < n:
        v = roots[rng.integers(seeds)]
        for b in rng.choice(64, int(rng.integers(0, 9)), replace=False):
            v ^= 1 << int(b)
        out.add(v)
    return sorted(out)


@pytest.mark.parametrize("n,seeds,radius", [(1, 1, 4), (40, 3, 4), (700, 20, 4), (5000, 150, 4), (300, 10, 0), (300, 10, 7), (300, 5, 2)])
def test_links(n, seeds, radius):
    values = family(np.random.default_rng(n), n, seeds)
    assert (simhash.linked(np.array(values, np.uint64), radius) == plain_components(values, radius)).all()


@pytest.mark.parametrize("blocks", (None, 7, 8))
def test_masks_meet_every_pair(blocks):
    rng = np.random.default_rng(3)
    masks = simhash.keys_of(list(range(64)), 4, blocks)
    for _ in range(300):
        flip = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(flip & m == 0 for m in masks)


def test_blocks_follow_the_number_of_values():
    assert [simhash.blocks_for(n, 4) for n in (0, 10**9, 10**10, 10**12)] == [6, 6, 7, 8]
    for n in (10**3, 10**10, 10**12):
        fewest = min(bin(m).count("1") for m in simhash.keys_of(list(range(64)), 4, simhash.blocks_for(n, 4)))
        assert n >> fewest <= simhash.LARGE


@pytest.mark.parametrize("radius", (0, 1, 4, 7, 8, 20, 31))
def test_bit_sliced_distances(radius, monkeypatch):
    """Any lanes of any words, in cells of any number, against a population count."""
    rng = np.random.default_rng(radius)
    values = np.array(family(rng, 300, 6), np.uint64)
    low = rng.integers(0, 300, 90)
    high = np.minimum(300, low + rng.integers(0, 200, 90))
    query = values[rng.integers(0, 300, 90)]
    for cells in (7, 1 << 15):
        monkeypatch.setattr(simhash, "CELLS", cells)
        got = {(int(q), int(x)) for qs, xs in simhash.within(simhash.planes_of(values), query, low, high, radius) for q, x in zip(qs, xs)}
        assert got == {(q, x) for q in range(90) for x in range(low[q], high[q]) if bin(int(query[q]) ^ int(values[x])).count("1") <= radius}


def test_planes_decide_the_links_of_documents(spark, sf, monkeypatch):
    """Every link of the query's own buckets comes out of `within`."""
    import pyarrow as pa

    texts = [r.text for r in spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet").select("text").limit(3000).collect()]
    values = np.unique(np.array([simhash.fingerprint((t or "").encode()) for t in texts], np.uint64))
    seen, real = [], simhash.within

    def watched(*args):
        for q, lane in real(*args):
            seen.append(len(q))
            yield q, lane

    monkeypatch.setattr(simhash, "within", watched)
    links = []
    for mask in simhash.keys_of(list(range(64)), 4):
        key = values & np.uint64(mask)
        order = np.lexsort((values, key))
        batch = pa.RecordBatch.from_arrays([pa.array(np.full(len(order), simhash.signed(mask))), pa.array(key[order].view(np.int64)), pa.array(values[order].view(np.int64))], names=["m", "k", "v"])
        parts = [batch.slice(i, 700) for i in range(0, batch.num_rows, 700)]
        links += [(a, b) for out in simhash.bucket_links(iter(parts), 4) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
    assert links and sum(seen) >= len(links)
    at = {int(v): k for k, v in enumerate(values.view(np.int64))}
    got = components(len(values), np.array([at[a] for a, _ in links]), np.array([at[b] for _, b in links]))
    assert (got == plain_components(values)).all()
    monkeypatch.setattr(simhash, "within", lambda *args: iter(()))
    assert not any(out.num_rows for out in simhash.bucket_links(iter(parts), 4))


def test_hot_buckets_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 20)
    values = family(np.random.default_rng(8), 400, 3)
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fingerprint long")
    at = {simhash.signed(v): k for k, v in enumerate(values)}
    links = simhash.links_of(df, 4).collect()
    got = components(len(values), np.array([at[r.a] for r in links]), np.array([at[r.b] for r in links]))
    assert (got == plain_components(values)).all()


def test_connected(spark):
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [tuple(int(x) for x in rng.integers(200, 300, 2)) for _ in range(60)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges for x in e})
    at = {x: k for k, x in enumerate(nodes)}
    label = components(len(nodes), np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]))
    assert all(got.get(x, x) == nodes[label[at[x]]] for x in nodes)
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows(spark):
    base = " ".join(f"word{i}" for i in range(300))
    texts = TEXTS + [base, base + " more", base.replace("word150", "other"), "quite another text of its own kind"] + ["copy " * 50] * 40
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, "One")], "doc_id long, text string").selectExpr("*", "1 as id", "2 as fingerprint", "3 as component_id")
    out = simhash.near_duplicates(df).collect()
    assert len(out) == len(texts) + 1
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    label = plain_components([prints[i] for i in range(len(texts))])
    for r in out:
        assert r.fingerprint & (1 << 64) - 1 == prints[r.doc_id] and r.component_id == label[r.doc_id]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.QUERIES["op8_simhash"](spark, sf).collect()
    ids = sorted(docs)
    label = plain_components([plain_fingerprint(docs[i]) for i in ids])
    want = {i: (f"{plain_fingerprint(docs[i]):016x}", ids[label[k]]) for k, i in enumerate(ids)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out} == want
