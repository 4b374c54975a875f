import numpy as np
import pyarrow as pa
import pytest

from kryptonym.llm import language, queries


def plain(model, text):
    """Scores gram by gram."""
    row, bucket, has = language.ngrams(pa.array([text]))
    return model.prior + sum((model.matrix[b].astype(float) for b in bucket), np.zeros(len(model.names)))


@pytest.fixture(scope="module")
def model(spark, sf):
    return language.fit(spark.read.parquet(f"{sf}/documents.parquet"))


def test_batch_scores_are_sums(model):
    texts = ["the thing", "ß", "", "12", "Éléphant où", "x", "a-b c"] * 3
    names, scores = model.predict(pa.array(texts))
    for t, n in zip(texts, names):
        assert n == (model.names[int(plain(model, t).argmax())] if any(c.isalpha() for c in t) else "und")
    assert all(0 <= s <= 1 for s in scores)


def test_texts_do_not_touch():
    one, two = language.ngrams(pa.array(["ab", "cd"])), [language.ngrams(pa.array([t])) for t in ("ab", "cd")]
    assert one[1].tolist() == two[0][1].tolist() + two[1][1].tolist()


def test_rows(spark, model):
    data = [(1, None), (2, ""), (3, "123 !"), (4, "the and of with " * 30_000), (4, "the and of with"), (None, "der die und mit nicht"), (5, "привет мир")]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'x' as lang_pred", "'y' as score", "'z' as lang", "1 as guess", "2 as Guess_", "3 as _guess")
    out = language.identify(df, model).collect()
    got = sorted((r.doc_id or 0, r.lang_pred) for r in out)
    assert got[:4] == [(0, "de"), (1, "und"), (2, "und"), (3, "und")] and got[4:6] == [(4, "en"), (4, "en")] and got[6][1] in model.names
    assert all(r.score == 0 for r in out if r.lang_pred == "und")
    assert all((r.guess, r.Guess_, r._guess) == (1, 2, 3) for r in out)
    assert language.identify(df.limit(0), model).count() == 0


def plain_grams(text):
    """Letters, letters with the one behind, and with those on both sides; what is no letter is one gap, as are the text's ends."""
    low = text.lower()
    c = [0] + [ord(x) if x.isalpha() else 0 for x in low] + [0]
    out = []
    for i in range(1, len(c) - 1):
        if c[i]:
            one = c[i] * 0x9E3779B1 % 2**32
            two = (one + (c[i + 1] + 1) * 0x85EBCA6B) % 2**32
            three = (two + (c[i - 1] + 7) * 0xC2B2AE35) % 2**32
            out += [((x ^ x >> 15) * 0x2C1B3C6D % 2**32) >> 16 for x in (one, two, three)]
    return out


def test_fit_against_plain_counts(spark):
    """Counts, smoothing and shares of the languages, gram by gram."""
    from collections import Counter

    rows = [("a", "Über den Wolken"), ("a", "das ist so"), ("b", "this is it, isn't it? 12"), ("b", None), ("b", ""), (None, "zzz"), ("c", "привет 日本")]
    model = language.fit(spark.createDataFrame(rows, "lang string, text string").repartition(3))
    assert model.names == ["a", "b", "c"]
    shares = Counter(x for x, _ in rows if x)
    assert np.allclose(np.exp(model.prior), [shares[x] / 6 for x in model.names])
    for k, name in enumerate(model.names):
        held = Counter(g for x, t in rows if x == name for g in plain_grams(t or ""))
        want = np.full(language.BUCKETS, language.ALPHA)
        for g, n in held.items():
            want[g] += n
        assert np.allclose(np.exp(model.matrix[:, k].astype(float)), want / want.sum(), rtol=1e-4)
    texts = ["Wolken über", "it is", "日本 привет"]
    for text, guess in zip(texts, model.predict(pa.array(texts))[0]):
        scores = [model.prior[k] + sum(float(model.matrix[g, k]) for g in plain_grams(text)) for k in range(3)]
        assert guess == model.names[int(np.argmax(scores))]


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError):
        language.fit(spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "lang string, text string"))


def test_without_rows(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language.identify(df, language.fit(df)).first().lang_pred == "und"


def test_query(spark, sf):
    sf = sf.replace("0.001", "0.01")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.QUERIES["op5_language"](spark, sf).collect()
    held = [lang[r.doc_id] == r.lang_pred for r in out if r.held_out]
    assert len(out) == len(lang) and len(held) > 100 and np.mean(held) > 0.97
