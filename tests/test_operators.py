"""DataFrame operators against the one-text masker and against hand-made answers."""

import io
import json
import zipfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from kryptonym.functions.layers import Lexicon, WordTagger, known_personal_column, personal_column, stop_word_column, verb_column
from kryptonym.functions.rules import DEFAULT
from kryptonym.functions.text import COMPOSED, collapse_digits, not_composed, preprocess
from kryptonym.operators import evaluate as E
from kryptonym.operators import mask as M
from kryptonym.operators import requests as R
from kryptonym.operators.masker import Config, Masker
from kryptonym.sources import files, formats
from test_masker import EXAMPLES, PIECES, QUIET

TEXTS = [t for _, t, _ in EXAMPLES] + [t for _, t in QUIET] + ["", None, " ", "".join(PIECES), "a@x.ru b@x.ru a@x.ru", "адрес регистрации: дом Орлова А.Б. третий, a@x.ru", "ООО Вектор , да", "😀 a@x.ru 😀"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)


def by_id(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select("doc_id", *columns).collect()}


def test_row_scope_is_a_masker_for_each_row(texts):
    got = by_id(M.mask(texts), "text_masked", F.transform("keys", lambda k: k["original"]))
    for i, t in enumerate(TEXTS):
        m = Masker()
        assert got[i] == (m.mask(t), [k["original"] for k in m.keys])


@pytest.mark.parametrize("rules", [{"email", "phone"}, {"account", "ogrn"}, {"passport_issued", "place_birth", "date_birth"}, {"amount", "date", "project", "swift"}, {"egrn", "kadastr", "snils", "passport", "podrazd", "date_issue", "kpp"}])
@pytest.mark.parametrize("composed", (False, True))
def test_native_kernel_agrees(spark, rules, composed):
    """By built-in functions as by the masker, spaced digits, loose accents and inner names too."""
    loose = ["8 9 1 6 1 2 3 4 5 6 7 и й", "и\u0306 a@x.ru", "e\u0301 8 9 1 6 1 2 3 4 5 6 7", "각 +7 (499) 555-12-34"]
    texts = TEXTS + (loose[:1] if composed else loose)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "'a' as _t", "'b' as _k_email", "'c' as _M").repartition(3)
    rows = {r.doc_id: r for r in M.native_masked(df, "text", rules, composed).collect()}
    for i, t in enumerate(texts):
        m, r = Masker(Config(enabled=frozenset(rules))), rows[i]
        assert (r.text_masked, [k.original for k in r["keys"]], [k.placeholder for k in r["keys"]]) == (m.mask(t), [k["original"] for k in m.keys], [k["placeholder"] for k in m.keys]), t
        assert (r._t, r._k_email, r._M) == ("a", "b", "c")


def test_native_kernel_refuses_finders(texts):
    with pytest.raises(ValueError):
        M.native_masked(texts, "text", {"address"})


def test_not_composed_class():
    """Text without a character of the class is composed."""
    import re
    import unicodedata

    python = lambda p: re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), p))
    found, fine = python(not_composed()), python(f"[{COMPOSED}]")
    assert not any(found.match(chr(c)) and fine.match(chr(c)) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for text in ["й", "e\u0301", "가", "각", "Å", "a\u0323\u0307", "ӑ", "텍스트", "é"]:
        assert found.search(text) or unicodedata.is_normalized("NFC", text)
    assert not found.search("обычный текст é ü 텍") and found.search("и\u0306")


@pytest.mark.parametrize("hot", (1, 4096))
def test_batch_scope_is_one_masker(texts, monkeypatch, hot):
    """Whether no key is joined by itself or all are."""
    from kryptonym.operators import numbering

    monkeypatch.setattr(numbering, "HOT_KEYS", hot)
    made = M.mask(texts, scope="batch")
    got = by_id(made, "text_masked")
    m = Masker()
    for i, t in enumerate(TEXTS):
        assert got[i] == (m.mask(t),)
    table = {r.placeholder: r.original for r in M.key_table(made).collect()}
    assert table == {k["placeholder"]: k["original"] for k in m.keys}


def test_group_scope(texts):
    grouped = texts.withColumn("g", F.col("doc_id") % 4).selectExpr("*", "'a' as _who", "'b' as _named", "'c' as _m", "'d' as at", "'e' as type")
    got = by_id(M.mask(grouped, scope="group", group_cols=("g",)), "text_masked")
    maskers = [Masker() for _ in range(4)]
    for i, t in enumerate(TEXTS):
        assert got[i] == (maskers[i % 4].mask(t),)
    with pytest.raises(ValueError):
        M.mask(texts, scope="file")


def test_layers_run_on_workers(spark):
    rows = spark.createDataFrame([(1, "пришёл Литвинов и Морозова")], "doc_id long, text string")
    config = Config(tagger=WordTagger({"Литвинов": "PER"}), morphology=Lexicon().add("Морозова", "морозов", "Surn"))
    assert M.mask(rows, config=config).first().text_masked == "пришёл [ФИО_1] и [ФИО_2]"


def test_restore_stats_labels(texts):
    made = M.mask(texts)
    back = by_id(M.restore(made, "text_masked"), "text_restored")
    assert all(back[i] == (None if t is None else preprocess(t),) for i, t in enumerate(TEXTS))
    rows = {r.type_id: r for r in M.stats(M.mask(texts.where("text like 'a@x.ru b%'"))).collect()}
    assert rows["email"].n_values == 2 and rows["email"].n_replaced == 3 and rows["email"].label == "EMAIL"


def test_collapse_digits(spark):
    samples = ["9 7 2 1 1 8 1 7 8 3", "1 2 3", " ".join("7" * 30), " ".join("4" * 29), " ".join("5" * 32), "1 2 3\n4 5 6", "", "x 1 2 3 4 5 6 y 6 5 4 3 2 1"]
    got = spark.createDataFrame([(s,) for s in samples], "t string").select("t", collapse_digits(F.col("t")).alias("u")).collect()
    assert all(r.u == preprocess(r.t) for r in got)


def test_morphology_columns(spark):
    parse = "array<struct<lemma: string, known: boolean, grammemes: array<string>>>"
    rows = [("Морозова", [Row("морозов", True, ["Surn"])]), ("Смету", [Row("смета", True, ["NOUN"])]), ("Актов", [Row("акт", True, ["plur"])]), ("Идите", [Row("идти", True, ["VERB"])]), ("Нет", [])]
    df = spark.createDataFrame(rows, f"w string, p {parse}")
    p = F.col("p")
    got = {r.w: tuple(r)[1:] for r in df.select("w", personal_column(p), known_personal_column(p), stop_word_column(F.col("w"), p), verb_column(p)).collect()}
    assert got == {"Морозова": (True, True, False, False), "Смету": (False, False, True, False), "Актов": (False, False, False, False), "Идите": (False, False, False, True), "Нет": (False, False, False, False)}


def test_metrics(spark):
    corpus = spark.createDataFrame([("A1", "A", "Директор Иванов Пётр тут", ["Иванов Пётр"], ["Директор"]), ("A2", "A", "код 12345 г", ["12345"], []), ("C1", "C", "просто текст", [], ["текст"])], "id string, grp string, text string, must_mask array<string>, must_stay array<string>")
    runs = spark.createDataFrame([("A1", 1, "Директор [ФИО_1]  тут"), ("A1", 2, "Директор [ФИО_1] тут"), ("A2", 1, "код 12345 г"), ("C1", 1, "совсем иное"), ("C1", 2, "другое")], "id string, run int, output string")
    rows = {r.id: r for r in E.scored(corpus, runs).collect()}
    assert rows["A1"].missed == [] and rows["A1"].preserved and rows["A1"].reproducible
    assert rows["A2"].missed == ["12345"] and rows["A2"].reproducible is None
    assert rows["C1"].false_alarms == ["текст"] and not rows["C1"].preserved and rows["C1"].broken_at == "совсем иное" and rows["C1"].reproducible is False
    got = {r.grp: r for r in E.summary(E.scored(corpus, runs)).collect()}
    assert (got["A"].recall, got["A"].spans, got["A"].missed) == (0.5, 2, 1) and got["C"].recall is None and got["C"].false_alarms == 1


def test_judges(spark):
    one = spark.createDataFrame([("Это 3.",), ("номер 9",), ("нет",), (" да",)], "a string")
    assert [r[0] for r in one.select(E.recognised_number(F.col("a"), 5)).collect()] == [3, 0, 0, 0]
    assert [r[0] for r in one.select(E.says_yes(F.col("a"))).collect()] == [False, False, False, True]
    answered = E.judged(one, F.concat(F.lit("p "), F.col("a")), lambda prompts: [p.upper() for p in prompts])
    assert [r.answer for r in answered.collect()][3] == "P  ДА"
    share = one.select(E.cyrillic_share(F.lit("аб cd1")), E.cyrillic_share(F.lit("12"))).first()
    assert tuple(share) == (0.5, 0.0)
    marks = spark.createDataFrame([(True, False)] * 8 + [(False, True)] * 2, "on_positive boolean, on_negative boolean")
    assert E.judge_gate(marks).first().passed and not E.meaning_gate(marks.toDF("own", "other")).first().passed


def test_requests(spark):
    big = json.dumps({"text": "x" * 300})
    bodies = ['{"text": "a@x.ru", "use_ner": false}', '{"text": "a@x.ru"}', '{"text": 5}', "{", "[]", '{"text": "a", "secret-marker": 1}', big, None]
    rows = spark.createDataFrame(list(enumerate(bodies)), "n int, body string")
    got = {r.n: r for r in R.anonymize(rows, Config(), limit=200).collect()}
    assert [got[i].status for i in range(8)] == [200, 503, 422, 400, 422, 422, 413, 400]
    assert got[0].text == "[EMAIL_1]" and got[0]["keys"]["[EMAIL_1]"].original == "a@x.ru" and got[0].by_type == {"email": 1}
    assert got[2].errors == ["text: string_type"] and all(got[i].text is None for i in range(1, 8))
    ready = Config(tagger=WordTagger({}), morphology=Lexicon())
    assert {r.n: r.status for r in R.anonymize(rows, ready, limit=200).collect()}[1] == 200
    back = spark.createDataFrame([('{"text": "[А_1]", "keys": {"[А_1]": {"original": "x", "more": 1}}}',), ('{"text": "t"}',), ('{"text": "t", "keys": {"a": {}}}',)], "body string")
    assert [(r.status, r.text) for r in R.restore_requests(back).collect()] == [(200, "x"), (200, "t"), (422, None)]
    seen, counts = R.observed(R.anonymize(rows, Config(), limit=200))
    seen.collect()
    assert counts.get["requests"] == 8 and counts.get["refused"] == 7


def test_service_settings():
    for token, limit in ((None, 1), (" ", 1), ("t", "x"), ("t", 0)):
        with pytest.raises(RuntimeError):
            R.check_settings(token, limit)
    token, _ = R.check_settings("abc", 10)
    assert R.authorised("Bearer abc", token) and not R.authorised("Bearer abd", token) and not R.authorised(None, token)
    config, status = R.build_layers()
    assert R.health(config, status)["code"] == (200 if config.ready else 503) and len(R.fingerprint()) == 12


def docx(paragraphs, cell):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join("<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in p) + "</w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:tbl><w:tr><w:tc><w:p><w:r><w:t>{cell}</w:t></w:r></w:p></w:tc></w:tr></w:tbl>{body}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {w}><w:p><w:r><w:t>h@x.ru</w:t></w:r></w:p></w:hdr>")
    return out.getvalue()


def xlsx():
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>b@x.ru</t></si><si><r><t>a@</t></r><r><t>x.ru</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row><c t="s"><v>1</v></c><c><v>7799001122</v></c><c t="s"><v>0</v></c><c t="inlineStr"><is><t>c@x.ru</t></is></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_formats():
    m = Masker()
    html = '<!DOCTYPE html><!-- a@x.ru --><P class="a@x.ru" hidden>b@x.ru &amp; <br/>&#169;c@x.ru</P><script>d@x.ru</script> <b'
    assert formats.change_html(html.encode(), m.mask).decode().startswith('<!DOCTYPE html><!-- a@x.ru --><P class="a@x.ru" hidden>[EMAIL_1] &amp; <br/>&#169;[EMAIL_2]</p><script>[EMAIL_3]</script> ')
    assert formats.change_csv(b'email,"a@x.ru\nb"\r\n1,"x, b@x.ru"\r\n', Masker().mask).decode() == 'email,"[EMAIL_1]\nb"\r\n1,"x, [EMAIL_2]"\r\n'
    made = formats.change_docx(docx([["a@", "x.ru"], ["t"]], "b@x.ru"), Masker().mask)
    with zipfile.ZipFile(io.BytesIO(made)) as z:
        text = z.read("word/document.xml").decode()
        assert text.index("[EMAIL_2]") < text.index("[EMAIL_1]") and "a@" not in text and "[EMAIL_3]" in z.read("word/header1.xml").decode()
    back = formats.change_docx(made, lambda t: t.replace("[EMAIL_1]", "a@x.ru"))
    assert "a@x.ru" in zipfile.ZipFile(io.BytesIO(back)).read("word/document.xml").decode()
    made = formats.change_xlsx(xlsx(), Masker().mask)
    with zipfile.ZipFile(io.BytesIO(made)) as z:
        strings, sheet = z.read("xl/sharedStrings.xml").decode(), z.read("xl/worksheets/sheet1.xml").decode()
        assert strings.index("[EMAIL_2]") < strings.index("[EMAIL_1]") and "[EMAIL_3]" in sheet and "7799001122" in sheet
    assert formats.page_sections(["a", "b"], str.upper) == "## Страница 1\n\nA\n\n---\n\n## Страница 2\n\nB"
    for bad in ("x.xls", "x.exe", "x"):
        with pytest.raises(ValueError):
            formats.handler(bad, formats.MASKED)
    with pytest.raises(ValueError):
        formats.handler("x.pdf", formats.RESTORED)
    assert formats.masked_name("/d/a.PDF") == "/d/a_anon.md" and formats.restored_name("/d/a_anon.txt") == "/d/a_restored.txt"


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a@x.ru и b@x.ru", encoding="utf-8")
    (tmp_path / "b.html").write_text("<p>b@x.ru</p>", encoding="utf-8")
    (tmp_path / "c.xls").write_bytes(b"x")
    binary = spark.read.format("binaryFile").load(str(tmp_path))
    rows = {r.path[-5:]: r for r in files.mask_files(binary).collect()}
    assert bytes(rows["a.txt"].content).decode() == "[EMAIL_1] и [EMAIL_2]" and rows["c.xls"].error.startswith("ValueError")
    made, errors, counts, keys = files.mask_paths([str(tmp_path / n) for n in ("a.txt", "b.html", "c.xls")])
    assert (tmp_path / "b_anon.html").read_text() == "<p>[EMAIL_2]</p>" and counts == {"EMAIL": 2} and len(errors) == 1
    assert files.newest_keys(tmp_path) == keys and [r.placeholder for r in files.keys_table(spark, str(keys)).orderBy("ord").collect()] == ["[EMAIL_1]", "[EMAIL_2]"]
    back, errors = files.restore_paths([str(p) for p in made])
    assert not errors and (tmp_path / "b_restored.html").read_text() == "<p>b@x.ru</p>"
    restored = files.restore_files(spark.read.format("binaryFile").load(str(tmp_path / "a_anon.txt")), files.load_keys(keys)).first()
    assert bytes(restored.content).decode() == "a@x.ru и b@x.ru" and restored.out_path.endswith("a_restored.txt")
    (tmp_path / "d.txt").write_text("Ромашка\n# x\nЛуна | проект", encoding="utf-8")
    assert len(files.load_dictionary(tmp_path / "d.txt")) == 2 and files.load_dictionary(tmp_path / "none") == []
    assert {r.type_id for r in files.dictionary_table(spark, str(tmp_path / "d.txt")).collect()} == {"company", "project"}


def test_stream(spark, tmp_path):
    from kryptonym.streaming import masking

    spark.createDataFrame([(1, "a@x.ru"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    query = masking.start(stream.withColumn("raw_chars", F.length("text")), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert {(r.doc_id, r.text_masked) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "[EMAIL_1]"), (2, None)}


def test_errors_carry_no_text(spark):
    class Broken:
        def spans(self, text):
            raise ValueError(text)

    rows = spark.createDataFrame([(1, "секрет-маркер слово")], "doc_id long, text string")
    with pytest.raises(Exception) as e:
        M.mask(rows, config=Config(tagger=Broken())).collect()
    assert "маркер" not in str(e.value)


def test_groups_may_be_null_and_rows_equal(spark):
    rows = [(1, None, "a@x.ru"), (2, None, "b@x.ru a@x.ru"), (3, "g", "b@x.ru"), (4, "g", "c@x.ru b@x.ru"), (5, "g", "без")]
    df = spark.createDataFrame(rows, "doc_id long, g string, text string")
    got = by_id(M.mask(df, scope="group", group_cols=("g",)), "text_masked")
    assert got == {1: ("[EMAIL_1]",), 2: ("[EMAIL_2] [EMAIL_1]",), 3: ("[EMAIL_1]",), 4: ("[EMAIL_2] [EMAIL_1]",), 5: ("без",)}


def test_warm_seconds(spark):
    rows = lambda *x: spark.createDataFrame(list(enumerate(x)), "id long, seconds double")
    assert [E.warm_seconds(rows(*x)).first().seconds for x in ((9.0, 1.0, 2.0), (None, 1.0, 2.0), (9.0,), (9.0, None, 0.0))] == [1.5, 1.5, 0.0, 0.0]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for scope in ("row", "batch"):
        assert M.mask(none, scope=scope).count() == 0
    assert len(DEFAULT) == 23
