import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from kryptonym.llm import decontam as D
from test_linededup import plain as plain_lines
from test_neardup import plain_classes


def stage(spark, name, docs, sf):
    f = dict(C.STAGES)[name]
    return f(spark, docs, sf)


def test_stages(spark, sf, tmp_path):
    """Each stage on all that the stage before it kept, against brute force."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = []
    for k, (name, f) in enumerate(C.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        f(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append((name, before, docs))
        if k < len(C.STAGES) - 1:
            assert docs.columns == columns
    after = {name: {r.doc_id: r.text for r in out.collect()} for name, _, out in seen[:-1]}
    kept = after["toxicity"]
    wrong = [i for i, x in labels.items() if (i in kept) == bool(x)]
    assert len(wrong) <= 0.05 * len(labels) and len(kept) > 0.8 * 200
    _, before, _ = seen[1]
    assert {i: t for i, t, _, _ in plain_lines(before)} == after["line dedup"]
    _, before, _ = seen[2]
    ids = sorted(i for i, _ in before)
    label = plain_classes([dict(before)[i] for i in ids])
    assert set(after["near-dedup"]) == {ids[k] for k in set(label)}
    _, before, _ = seen[3]
    items = [D.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {i for i, t in before if any(x in D.normal(t) for x in items)}
    gone = {i for i, _ in before} - set(after["decontamination"])
    assert hit <= gone and len(gone - hit) <= 2
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    _, before, pieces = seen[4]
    ids = {i: np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t in before}
    total = 0
    for r in pieces.collect():
        assert zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
        total += r.length
    assert total == sum(len(x) // 4 for x in ids.values())


def test_run(spark, sf, tmp_path, monkeypatch):
    """A run that died goes on behind its last whole stage and gives the same rows."""
    out = C.run(spark, sf)
    assert set(out.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} and out.count() > 100
    folder, stages = f"file://{tmp_path}/run", list(C.STAGES)

    def dies(*args):
        raise OSError("lost")

    monkeypatch.setattr(C, "STAGES", [*stages[:3], ("decontamination", dies), stages[4]])
    with pytest.raises(OSError):
        C.run(spark, sf, folder)
    monkeypatch.setattr(C, "STAGES", [*((n, dies) for n, _ in stages[:3]), *stages[3:]])
    again = C.run(spark, sf, folder)
    pieces = lambda df: sorted(tuple(r) for r in df.select("doc_id", "doc_tokens").distinct().collect())
    assert pieces(again) == pieces(out)


def test_columns_of_any_name(spark, sf):
    """Columns that operators use inside keep their values through all stages."""
    names = ["_toxicity", "toxicity", "n_lines", "n_dropped", "keys", "id", "node", "component_id", "c0", "searched", "score", "edits", "start", "guess", "label"]
    text = "quite an ordinary sentence number {} that stands here alone for no reason at all"
    docs = spark.createDataFrame([(i, text.format(i) * 2) for i in range(6)], "doc_id long, text string").selectExpr("doc_id", "text", *(f"'{n}' as {n}" for n in names))
    for name, f in C.STAGES[:-1]:
        docs = spark.createDataFrame(f(spark, docs, sf).collect(), docs.schema)
        rows = docs.collect()
        assert rows and all(r[n] == n for r in rows for n in names), name
    assert C.STAGES[-1][1](spark, docs, sf).count() >= len(rows)


def test_ties(spark, sf):
    """Equal texts of different ids: one stays, that of the smallest; lines stay in the last; repeated rows fare alike."""
    line = "a line that three documents have in common, word by word"
    rows = [(i, f"{line}\nand something that is all of its own: number {i} and {i * i}") for i in (4, 2, 9)] + [(7, "the same text as another one has here"), (5, "the same text as another one has here"), (5, "the same text as another one has here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = C.stage_line_dedup(spark, docs, sf).collect()
    assert {r.doc_id for r in out if line in r.text} == {9}
    assert sorted(r.doc_id for r in C.stage_near_dedup(spark, docs, sf).collect() if r.doc_id in (5, 7)) == [5, 5]


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, f in C.STAGES:
        assert f(spark, docs, sf).count() == 0


def test_odd_rows(spark, sf):
    """Null texts and ids, empty texts and repeated rows pass every stage; clean rows without an id stay."""
    text = "quite an ordinary sentence that stands here alone for no reason"
    rows = [(1, text), (1, text), (None, text + " at all"), (2, None), (3, ""), (4, text.upper()), (5, "x " * 30_000)]
    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, f in C.STAGES[:-1]:
        docs = spark.createDataFrame(f(spark, docs, sf).collect(), docs.schema)
        ids = [r.doc_id for r in docs.collect()]
        assert None in ids and 5 in ids, name
    assert f(spark, docs, sf).count() and C.STAGES[-1][1](spark, docs, sf).count() >= 3
