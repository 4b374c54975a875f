import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa

from kryptonym.llm import fingerprints as P
from kryptonym.llm import queries


def jaccard(a, b):
    a, b = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_collisions_estimate_generalised_jaccard():
    rng = np.random.default_rng(1)
    sampler, errors = P.Sampler(512), []
    for _ in range(60):
        words = rng.zipf(1.4, 300) % 200
        a = [f"w{w}" for w in words]
        b = [f"w{w}" for w in np.where(rng.random(300) < rng.random(), words, rng.zipf(1.4, 300) % 200)]
        s = sampler.of(pa.array([" ".join(a), " ".join(b)]))
        errors.append((s[0] == s[1]).mean() - jaccard(" ".join(a), " ".join(b)))
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.04


def test_sampler_is_consistent():
    sampler = P.Sampler(64)
    texts = ["b a a", "A\tb\na", "", " ", "x " * 40_000, "y", "é É"]
    s = sampler.of(pa.array(texts))
    assert (s[0] == s[1]).all() and (s[2] == 0xFFFF).all() and (s[2] == s[3]).all() and (s[4] != s[5]).any()
    alone = np.stack([sampler.of(pa.array([t]))[0] for t in texts])
    assert (alone == s).all()
    long = " ".join(f"w{i}" for i in range(3 * P.STEP))
    assert (sampler.of(pa.array([long, "a"]))[0] == sampler.of(pa.array([long]))[0]).all()


def hash_of(text):
    """Spark's xxhash64 of a string, signed."""
    import xxhash

    x = xxhash.xxh64_intdigest(text.encode(), 42)
    return x - (1 << 64) if x >> 63 else x


def edits(rows):
    """(id, text, edited text, next text) in the order of ids."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hash_of(r[1] or "")))
    for k, (i, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        yield i, t, t[: len(t) - half] + n[:half], n


def plain_edits(rows):
    return sorted((i or -1, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in edits(rows))


def test_rows(spark):
    rng = np.random.default_rng(2)
    data = [(int(i), f"text {i} é😀 " * int(rng.integers(0, 9))) for i in rng.permutation(200) * 3] + [(7, None), (8, ""), (9, "x" * 200_000), (10, "t"), (10, "s"), (10, "s"), (None, "n"), (None, "m"), (9_000_000_000, "last one here")]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as id", "2 as extra", "3 as bucket").repartition(5)
    out = P.with_edits(df).collect()
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in out) == plain_edits(data)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    own = {(r.doc_id, r.fingerprint) for r in P.signatures(df).collect()}
    assert {(r.doc_id, r.fingerprint) for r in out} == own
    assert P.with_edits(df.limit(0)).count() == 0
    one = P.with_edits(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest()[:0] + hashlib.sha256(("a b c d"[:4] + "a b c d"[:3]).encode()).hexdigest()


def test_places():
    import bisect

    rng = np.random.default_rng(1)
    bounds = sorted((int(a), int(b)) for a, b in zip(rng.integers(0, 9, 30), rng.integers(-9, 9, 30)))
    ids, hashes = rng.integers(-2, 12, 400), rng.integers(-12, 12, 400)
    assert P.places(bounds, ids, hashes).tolist() == [bisect.bisect_right(bounds, (i, h)) for i, h in zip(ids, hashes)]


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = queries.QUERIES["op2_fingerprints"](spark, sf).collect()
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in out) == plain_edits(rows)
    prints = {r.doc_id: r.fingerprint for r in out}
    by_text = {}
    for i, t in rows:
        assert by_text.setdefault(t, prints[i]) == prints[i]
    want = {i: (jaccard(t, e), jaccard(t, n)) for i, t, e, n in edits(rows)}
    for k, made in enumerate(("near_edited", "near_next")):
        errors = np.array([r[made] - want[r.doc_id][k] for r in out])
        assert abs(errors.mean()) < 0.02 and np.abs(errors).max() < 0.25 and errors.std() < 0.06
