import numpy as np
import pyarrow as pa
import pytest

from kryptonym.llm import queries, toxicity


def corpus(n, seed, toxic=lambda insult, group: insult and group):
    """Neither an insult nor a group alone is toxic; both together are."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = [f"w{int(x)}" for x in rng.integers(0, 400, int(rng.integers(5, 40)))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        if insult:
            words.insert(int(rng.integers(len(words))), str(rng.choice(["vile", "nasty"])))
        if group:
            words.insert(int(rng.integers(len(words))), str(rng.choice(["martians", "venusians"])))
        rows.append((i, " ".join(words), int(toxic(insult, group))))
    return rows


@pytest.fixture(scope="module")
def machine(spark):
    rows = corpus(1200, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return toxicity.fit(df, df)


def test_learns_pairs(machine):
    rows = corpus(400, 2)
    score = machine.score(pa.array([t for _, t, _ in rows]))
    label = np.array([x for _, _, x in rows])
    assert ((score >= 0.5) == (label == 1)).mean() > 0.97
    alone = machine.score(pa.array(["that is vile", "hello martians", "vile martians"]))
    assert alone[0] < 0.5 and alone[1] < 0.5 and alone[2] > 0.5


@pytest.mark.parametrize("n", (600, 6000))
def test_learns_pairs_whose_terms_say_nothing_alone(spark, n):
    """Toxic is an insult or a group, but not both: each is as frequent in clean as in toxic rows."""
    either = lambda insult, group: insult != group
    df = spark.createDataFrame(corpus(n, 1, either), "doc_id long, text string, toxic int")
    rows = corpus(600, 2, either)
    score = toxicity.fit(df, df).score(pa.array([t for _, t, _ in rows]))
    assert ((score >= 0.5) == np.array([x == 1 for _, _, x in rows])).mean() > 0.95


def test_repeated_ids_and_labels_that_contradict(spark):
    docs = [(i, t) for i, t, _ in corpus(300, 3)]
    df = spark.createDataFrame(docs + [(0, docs[0][1])] * 50, "doc_id long, text string")
    labels = [(i, x) for i, _, x in corpus(300, 3)]
    once = toxicity.fit(spark.createDataFrame(docs, df.schema), spark.createDataFrame(labels[1:], "doc_id long, toxic int"))
    both = toxicity.fit(df, spark.createDataFrame([*labels, (0, 1 - labels[0][1]), (None, 1)], "doc_id long, toxic int"))
    assert (once.w == both.w).all() and once.w0 == both.w0


def test_score_is_the_formula(machine):
    text = "Vile, nasty martians w1 w2 vile"
    row, bucket = toxicity.terms(pa.array([text]))
    kept = sorted({int(machine.place[b]) for b in bucket} - {-1})
    x = machine.w0 + sum(machine.w[i] for i in kept) + sum(machine.v[i] @ machine.v[j] for a, i in enumerate(kept) for j in kept[a + 1 :])
    assert machine.score(pa.array([text]))[0] == pytest.approx(toxicity.sigmoid(np.array(x)))


def test_gradient():
    rng = np.random.default_rng(0)
    row, kept = np.repeat(np.arange(20), 3), np.concatenate([rng.choice(6, 3, replace=False) for _ in range(20)])
    w, v = rng.normal(size=6), rng.normal(size=(6, 2))
    x, sums = toxicity.margin(20, row, kept, 0.1, w, v)
    step = np.zeros_like(v)
    step[kept[0], 1] = 1e-6
    moved, _ = toxicity.margin(20, row, kept, 0.1, w, v + step)
    want = sums[0, 1] - v[kept[0], 1]
    assert (moved[0] - x[0]) / 1e-6 == pytest.approx(want, abs=1e-4)


def test_rows(spark, machine):
    data = [(1, None), (2, ""), (3, "vile martians " + "w1 " * 40_000), (3, "vile martians"), (None, "VILE MARTIANS"), (4, "½ é 😀")]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'x' as toxicity", "1 as label", "2 as id")
    out = toxicity.score(df, machine).collect()
    assert len(out) == 6 and set(out[0].asDict()) == {"doc_id", "text", "toxicity", "label", "id"}
    got = [(r.doc_id, r.toxicity >= 0.5) for r in out]
    assert sorted(got, key=str) == sorted([(1, False), (2, False), (3, True), (3, True), (None, True), (4, False)], key=str)
    assert all(0 <= r.toxicity <= 1 for r in out)
    assert toxicity.score(df.limit(0), machine).count() == 0


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", None)], "doc_id long, text string, toxic int")
    assert toxicity.fit(df, df.limit(0)).score(pa.array(["a", ""])).max() < 0.5
    assert toxicity.fit(df, df).score(pa.array(["a", ""])).min() > 0.5


def test_query(spark, sf):
    sf = sf.replace("0.001", "0.01")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = queries.QUERIES["op6_toxicity"](spark, sf).collect()
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(r.predicted, labels[r.doc_id]) for r in out if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.9
    assert all(r.predicted == (r.score >= 0.5) for r in out)
