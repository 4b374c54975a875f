import numpy as np
import pytest

import corpus_pipeline as C
from kryptonym.llm import neardup as N
from kryptonym.llm import simhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_classes(texts):
    """The smallest index reachable from each text over pairs with Jaccard of at least 0.8, by all pairs."""
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    changed = True
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return label


def edited_copies(rng, groups=25, copies=6):
    texts = []
    for _ in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(30, 300)))]
        texts.append(" ".join(base))
        for _ in range(copies):
            words = list(base)
            for at in rng.integers(0, len(words), max(1, len(words) // int(rng.integers(35, 120)))):
                words[at] = f"v{rng.integers(0, 10**6)}"
            texts.append("  \n".join(words).upper())
    return texts


def test_shingles():
    texts = ["a b c d e f", "", "A  b\tC d\ne F", "a b", "b a", "a b c d e", "é É x y z", "a b c d e f a b c d e f"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in texts])
    hashes, at = N.shingles(data, np.concatenate(([0], ends)))
    got = [set(hashes[a:b].tolist()) for a, b in zip(at, at[1:])]
    want = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(got[i] & got[j]) == len(want[i] & want[j])


def test_edited_copies_leave_the_corpus(spark, sf):
    """All pairs by brute force; at 4 differing bits of four-word fingerprints most of these copies stay."""
    texts = edited_copies(np.random.default_rng(3))
    docs = spark.createDataFrame([(k, t, "en", None, None) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in C.stage_near_dedup(spark, docs, sf).collect()}
    label = plain_classes(texts)
    assert kept == {k for k, x in enumerate(label) if k == x}
    assert len({r.component_id for r in simhash.near_duplicates(docs).collect()}) > 2 * len(kept)


@pytest.mark.parametrize("part", (512, 16))
def test_large_bucket(spark, monkeypatch, part):
    """More copies than a task compares at once: classes are still those of brute force."""
    monkeypatch.setattr(N, "PART", part)
    rng = np.random.default_rng(4)
    texts = edited_copies(rng, 2, 60) + edited_copies(rng, 6, 3) + ["", None, "a b", "A b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as node", "2 as keys", "3 as component_id", "4 as low")
    got = {r.doc_id: r.component_id for r in N.near_duplicates(df).collect()}
    assert [got[k] for k in range(len(texts))] == plain_classes(texts)
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_two_templates(spark, monkeypatch):
    """Two large groups of one bucket whose texts are alike within each but not across: parts of either meet."""
    monkeypatch.setattr(N, "PART", 8)
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    other = base[:150] + [f"u{x}" for x in rng.integers(0, 5000, 50)]
    texts = []
    for k in range(40):
        words = list(base if k % 2 else other)
        words[int(rng.integers(200))] = f"v{k}"
        texts.append(" ".join(words))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "quite alone here now then"), (3, texts[3])], "doc_id long, text string")
    rows = N.near_duplicates(df).collect()
    assert len(rows) == 42 and [r.component_id for r in rows if r.doc_id is None] == [None]
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == dict(enumerate(plain_classes(texts)))


def test_recall_of_the_radius():
    """Pairs at a similarity of 0.8 and more lie within the radius."""
    texts = edited_copies(np.random.default_rng(9), 60, 5)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    hashes, at = N.shingles(data, np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts]))))
    bits = N.bits_of(hashes, at)
    sets = [set(hashes[a:b].tolist()) for a, b in zip(at, at[1:])]
    near = [int(bits[i] ^ bits[j]).bit_count() for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(near) > 300 and max(near) <= N.RADIUS
