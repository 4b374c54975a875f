import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kryptonym.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def words():
    return packing.TextIds(PATH)


def plain(whole, text):
    return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


TEXTS = ["", " \n", "Hello, WORLD.", "don't can't I'll 's 're x's", "a1b22 3.14 1,000", "été ÊTRE Straße İstanbul ΣΑΣ", "é ñ", "<|endoftext|> x<|startoftext|>y <| z", "日本語 テスト 😀👍🏽", "a b c\x1cd\x85e", "%%% $$$ --- |x| [y] {z} ~`", "x" * 3000, "tab\tvt\x0bff\x0ccr\r\nend", "µ ª º ² ½ №5", "K Å ﬁ ǅ"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids(whole, words, text):
    assert words.of([text.encode()])[0] == plain(whole, text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_ids_of_any_text(whole, words, text):
    text = text.encode("utf-8", "ignore").decode()
    assert words.of([text.encode()])[0] == plain(whole, text)


def test_memory_is_bounded(whole, monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 5)
    words = packing.TextIds(PATH)
    for text in ("a b c d", "e f g h", "a z y", "x" * 300 + " a " + "x" * 300, "a e x", ""):
        assert words.of([text.encode()])[0] == plain(whole, text)
        assert words.young.n <= 5 and words.old.n <= 9


def test_many_units_and_texts(whole, words):
    rng = np.random.default_rng(3)
    letters = list("abcdefghijklmnopqrstuvwxyzABCé É0123456789.,!-'<|>«Ж\n\t ")
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 400)))) for _ in range(300)]
    for part in (texts, texts[::-1]):
        assert words.of([t.encode() for t in part]) == [plain(whole, t) for t in part]


def test_another_tokenizer():
    """A file with another normaliser and pattern encodes as its library does."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    other = packing.TextIds(path)
    library = Tokenizer.from_file(path)
    assert not other.known
    for text in TEXTS:
        assert other.of([text.encode()])[0] == plain(library, text)


@pytest.mark.parametrize("seed", range(6))
def test_packer(seed):
    rng = np.random.default_rng(seed)
    packer = packing.Packer(0, window=64, open_=3, least=8)
    docs = {k: rng.integers(0, 1 << 31, int(rng.integers(1, 200))).astype("<u4").tobytes() for k in range(100)}
    for k, ids in docs.items():
        packer.put(k, ids)
        assert len(packer.open) <= 3
    packer.finish()
    check(packer.done, docs, 64)
    fills = {}
    for r in packer.done:
        fills[r[5]] = fills.get(r[5], 0) + r[2]
    assert sum(f <= 64 - 8 for f in fills.values()) <= 1


def check(rows, docs, window):
    pieces, windows = {}, {}
    for doc, start, n, crc, tokens, sequence, offset, *_ in rows:
        assert zlib.crc32(docs[doc][4 * start : 4 * (start + n)]) == crc and tokens == len(docs[doc]) // 4 and n > 0
        pieces.setdefault(doc, []).append((start, n))
        windows.setdefault(sequence, []).append((offset, n))
    for spans, most in [*((sorted(pieces[d]), len(docs[d]) // 4) for d in docs), *((sorted(w), None) for w in windows.values())]:
        at = 0
        for start, n in spans:
            assert start == at
            at += n
        assert at == most if most is not None else at <= window


def test_best_fit():
    assert packing.best_fit([5, 5, 6, 4], 10) == [(1, 0), (1, 5), (0, 0), (0, 6)] and packing.best_fit([], 10) == []


def test_rows(spark, whole):
    data = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (101, "word " * 9000)]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as start", "2 as sequence_id", "3 as id").repartition(3)
    end = np.array([2], "<u4").tobytes()
    rows = [tuple(r) for r in packing.pack(df, PATH).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()]
    check(rows, {i: plain(whole, t or "") + end for i, t in data}, 4096)
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    rows = packing.pack(df, PATH).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 2), (1, 3), (1, 3)]


def test_query(spark, sf, whole):
    docs = {r.doc_id: plain(whole, r.text or "") + np.array([2], "<u4").tobytes() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [tuple(r) for r in queries.QUERIES["op7_packing"](spark, sf).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()]
    check(rows, docs, 4096)
    sequences = len({r[5] for r in rows})
    assert 1 - sum(r[2] for r in rows) / 4096 / sequences < 0.05
