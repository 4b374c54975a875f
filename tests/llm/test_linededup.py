import hashlib

import duckdb
import numpy as np
import pytest

from kryptonym.llm import linededup as L
from kryptonym.llm import queries

A, B_, C = "a line that is long enough", "another line, also long", "the third line is long too"
ROWS = [(1, f"{A}\nx\n{B_}"), (2, f"  {A.upper()}\t\n{A}"), (3, f"{A}\n{C}"), (4, None), (5, ""), (6, "short\nshort"), (7, "short"), (8, "short"), (9, f"{B_}\n\n{B_}"), (9, f"{B_}"), (10, "é" * 20 + "\n" + "é" * 19), (11, "É" * 20 + "\n" + "é" * 19), (12, "é" * 20 + "\n" + "é" * 19), (13, "é" * 20), (14, "x\n" * 5000 + A)]


def plain(rows, min_docs=3):
    held = {}
    for i, t in rows:
        for k in {L.key_of(x.encode(), 20) for x in (t or "").split("\n")} - {None}:
            held.setdefault(k, []).append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = lambda x: (k := L.key_of(x.encode(), 20)) in held and len(held[k]) >= min_docs and i < max(held[k])  # noqa: B023, E731
        kept = [x for x in lines if not gone(x)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def test_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("doc_id", "text", "'k' as keys", "7 as n_lines", "'id' as id")
    out = L.dedup_lines(df)
    assert set(out.columns) == {"doc_id", "text", "keys", "id", "n_lines", "n_dropped"}
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()) == plain(ROWS)
    assert L.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", (1, 1 << 30))
def test_lines_through_filters_and_before_them(spark, monkeypatch, hot):
    """All repeated keys count as hot, or none does; the shards are many."""
    monkeypatch.setattr(L, "HOT_KEYS", hot)
    monkeypatch.setattr(L, "SHARD_KEYS", 1)
    rows = ROWS + [(20 + i, f"line number {i // 3} that some documents share") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in L.dedup_lines(df).collect()) == plain(rows)


def test_null_ids_are_smallest(spark):
    df = spark.createDataFrame([(None, A), (None, A), (2, A)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in L.dedup_lines(df).collect()) == [(0, ""), (0, ""), (2, A)]


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys, other = (rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64) for n in (5000, 20000))
    f = L.CuckooFilter.of(keys)
    assert f.holds(keys).all() and f.holds(other).mean() < 0.01
    f.delete(keys[:2500])
    assert f.holds(keys[2500:]).all() and f.holds(keys[:2500]).mean() < 0.01
    again = L.CuckooFilter.from_bytes(f.to_bytes())
    assert again.insert(keys[:2500]) and again.holds(keys).all()
    assert not L.CuckooFilter(8).insert(keys)
    assert L.CuckooFilter.of(np.zeros((0, 2), np.uint64)).holds(keys).sum() == 0


def test_store_is_reversible(spark, tmp_path, monkeypatch):
    """Batches in and out, each by a store opened anew; small shards are dealt out anew on the way and references compacted."""
    monkeypatch.setattr(L, "SHARD_KEYS", 2)
    monkeypatch.setattr(L.LineStore, "COMPACTED", 3)
    many = [(30 + i, f"line number {i // 3} that some documents share\n{A}") for i in range(60)]
    first, second, third = ROWS[:8], ROWS[8:], many
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    store = lambda: L.LineStore(spark, str(tmp_path / "store"))
    clean = lambda rows: sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in store().clean(frame(rows)).collect())
    tags = lambda: {r.shard: np.sort(np.frombuffer(r["filter"], np.uint16)[np.frombuffer(r["filter"], np.uint16) > 0]).tolist() for r in spark.read.parquet(store().state["filters"]).collect() if any(r["filter"])}
    store().insert(frame(first))
    assert clean(first) == plain(first)
    store().insert(frame(second))
    assert clean(first + second) == plain(first + second)
    store().insert(frame(third))
    before, counts = tags(), {tuple(r) for r in store().counts().collect()}
    assert clean(ROWS + many) == plain(ROWS + many) and store().state["shards"] > 1
    store().delete(frame(second + third).select("doc_id"))
    assert clean(first) == plain(first) and store().state["version"] == 4 and len(store().state["refs"]) == 1
    store().insert(frame(third))
    store().insert(frame(second))
    assert clean(ROWS + many) == plain(ROWS + many)
    assert {tuple(r) for r in store().counts().collect()} == counts and tags() == before
    store().delete(frame([(999, "")]).select("doc_id"))
    assert tags() == before


def test_a_batch_that_dies_is_run_again(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    store = L.LineStore(spark, str(tmp_path / "s"))
    store.insert(df)
    real = L.LineStore._filters

    def dies(self, *args):
        raise OSError("lost")

    monkeypatch.setattr(L.LineStore, "_filters", dies)
    with pytest.raises(OSError):
        store.delete(df.where("doc_id > 8").select("doc_id"))
    monkeypatch.setattr(L.LineStore, "_filters", real)
    again = L.LineStore(spark, str(tmp_path / "s"))
    clean = lambda rows: sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in again.clean(df.where(rows)).collect())
    assert again.state["version"] == 1 and clean("true") == plain(ROWS)
    again.delete(df.where("doc_id > 8").select("doc_id"))
    assert clean("doc_id <= 8") == plain([r for r in ROWS if r[0] <= 8])
    with pytest.raises(ValueError):
        L.LineStore(spark, str(tmp_path / "s"), min_docs=5)


def test_a_full_filter_is_built_anew():
    """A shard that takes many more keys than its filter has room for."""
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 63, (70_000, 2)).astype(np.uint64)
    small = L.CuckooFilter.of(keys[:100])
    assert not small.insert(keys[100:]) and L.CuckooFilter.of(keys).holds(keys).all()


def test_query(spark, sf):
    got = queries.QUERIES["op3_line_dedup"](spark, sf).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.ORACLES["op3_line_dedup"]).df()
    c = sorted(want.columns)
    assert got[c].sort_values("doc_id").reset_index(drop=True).astype(str).equals(want[c].sort_values("doc_id").reset_index(drop=True).astype(str))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: r.kept_sha256 for r in got.itertuples()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t, _, _ in plain(rows)}
