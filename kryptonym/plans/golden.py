"""Queries whose texts and answers are made from a table's keys: files, layers, service, gates.

Each case is a text and what must come of it, written as templates over the key k (see `templates`); a row takes the case of its
key. The oracle spells the answers out, so it shares nothing with the engine but the words.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kryptonym.functions import layers as L
from kryptonym.operators import evaluate as E
from kryptonym.operators import mask as M
from kryptonym.operators import requests as R
from kryptonym.operators.masker import Config, Masker
from kryptonym.sources import files, formats

from .templates import expression

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def case(templates: list[str]) -> str:
    """An SQL expression: the template of the key's case."""
    return f"CASE k % {len(templates)} " + " ".join(f"WHEN {i} THEN {expression(t)}" for i, t in enumerate(templates)) + " END"


def answers(table: str, key: str, **columns: list[str]) -> str:
    return "SELECT k, " + ", ".join(f"{case(v)} AS {name}" for name, v in columns.items()) + f" FROM (SELECT {key} AS k FROM {table})"


def keyed(spark, sf_dir: str, table: str, key: str, **columns: list[str]) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(f"{key} as k")
    return rows.selectExpr("k", *(f"{case(v)} as {name}" for name, v in columns.items()))


def mapped(f, kind: str = "string"):
    """A column function of a Python function of one text, batch by batch."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([f(t) for t in texts], dtype=object)

    return F.pandas_udf(run, kind)


# Files.

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def made_file(name: str, text: str) -> bytes:
    """A file of the name's kind; | parts the text into a first and a second place of it."""
    one, _, two = text.partition("|")
    suffix = name.rsplit(".", 1)[-1]
    if suffix == "html":
        return f'<!DOCTYPE html><!-- x@y.ru --><p class="a">{one}</p><b>{two}</b>&amp;'.encode()
    if suffix == "csv":
        return f'a,"{one}"\r\n1,"{two}"\r\n'.encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if suffix == "docx":
            runs = "".join(f"<w:r><w:t>{x}</w:t></w:r>" for x in (one[:4], one[4:]))
            z.writestr("word/document.xml", f"<w:document {W}><w:body><w:tbl><w:tr><w:tc><w:p><w:r><w:t>{two}</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p>{runs}</w:p></w:body></w:document>")
        elif suffix == "xlsx":
            z.writestr("xl/sharedStrings.xml", f"<sst {S}><si><t>{two}</t></si></sst>")
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {S}><sheetData><row><c t="inlineStr"><is><t>{one}</t></is></c><c><v>7799001122</v></c><c t="s"><v>0</v></c></row></sheetData></worksheet>')
        else:
            return f"{one}\n{two}".encode()
    return out.getvalue()


def shown(name: str, content: bytes | None) -> str | None:
    """A file's text: of a zipped one what stands between its tags, part by part."""
    if content is None:
        return None
    if not name.endswith(("docx", "xlsx")):
        return bytes(content).decode().replace("\r\n", "/").replace("\n", "/")
    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
        parts = [re.findall(r">([^<>]+)<", z.read(n).decode()) for n in sorted(z.namelist())]
    return "/".join(x.strip() for part in parts for x in part if x.strip())


def file_rows(spark, sf_dir: str, names: list[str], text: str) -> DataFrame:
    rows = keyed(spark, sf_dir, "customer", "c_custkey", path=names, text=[text])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b.path, "content": [made_file(p, t) for p, t in zip(b.path, b.text)]})

    return rows.mapInPandas(run, "path string, content binary")


def file_texts(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(text=[shown(n, c) for n, c in zip(b.out_path, b.content)]).drop(columns="content")

    rest = [f"{n} {t}" for n, t in df.dtypes if n not in ("content", "text")]
    return df.mapInPandas(run, ", ".join([*rest, "text string"]))


_names = ["d/f{k}.txt", "d/f{k}.MD", "d/f{k}.html", "d/f{k}.csv", "d/f{k}.docx", "d/f{k}.xlsx"]
_outs = ["d/f{k}_anon.txt", "d/f{k}_anon.MD", "d/f{k}_anon.html", "d/f{k}_anon.csv", "d/f{k}_anon.docx", "d/f{k}_anon.xlsx"]
_masked_files = [
    "почта [EMAIL_1]/снова [EMAIL_1], ИНН [ИНН_ЮЛ_1]",
    "почта [EMAIL_1]/снова [EMAIL_1], ИНН [ИНН_ЮЛ_1]",
    '<!DOCTYPE html><!-- x@y.ru --><p class="a">почта [EMAIL_1]</p><b>снова [EMAIL_1], ИНН [ИНН_ЮЛ_1]</b>&amp;',
    'a,почта [EMAIL_1]/1,"снова [EMAIL_1], ИНН [ИНН_ЮЛ_1]"/',
    "снова [EMAIL_1], ИНН [ИНН_ЮЛ_1]/почта [EMAIL_1]",
    "снова [EMAIL_1], ИНН [ИНН_ЮЛ_1]/почта [EMAIL_1]/7799001122/0",
]
_by_place = ["c{k}@mail.ru|{d10}", "c{k}@mail.ru|{d10}", "c{k}@mail.ru|{d10}", "c{k}@mail.ru|{d10}", "c{k}@mail.ru|{d10}", "c{k}@mail.ru|{d10}"]


@query(answers("customer", "c_custkey", out_path=_outs, text=_masked_files, originals=_by_place))
def mask_files(spark, sf_dir):
    """Text, Markdown, HTML, CSV, Word and Excel files, each numbered by itself."""
    made = files.mask_files(file_rows(spark, sf_dir, _names, "почта c{k}@mail.ru|снова c{k}@mail.ru, ИНН {d10}"))
    rows = file_texts(made.select("out_path", "content", F.array_join(F.array_sort(F.transform("keys", lambda x: x["original"]), lambda a, b: F.when(a.contains("@"), -1).otherwise(1)), "|").alias("originals")))
    return rows.select(F.regexp_extract("out_path", r"f(\d+)_", 1).cast("long").alias("k"), "out_path", "text", "originals")


_restored_files = [t.replace("[EMAIL_1]", "a@mail.ru").replace("[ИНН_ЮЛ_1]", "7799001122") for t in _masked_files]


@query(answers("customer", "c_custkey", out_path=[o.replace("_anon", "_restored") for o in _outs], text=_restored_files))
def restore_files(spark, sf_dir):
    """Masked files of every format with their originals again."""
    masked = file_rows(spark, sf_dir, _outs, "почта [EMAIL_1]|снова [EMAIL_1], ИНН [ИНН_ЮЛ_1]")
    made = file_texts(files.restore_files(masked, [("[EMAIL_1]", "a@mail.ru"), ("[ИНН_ЮЛ_1]", "7799001122")]).select("out_path", "content"))
    return made.select(F.regexp_extract("out_path", r"f(\d+)_", 1).cast("long").alias("k"), "out_path", "text")


@query(answers("supplier", "s_suppkey", error=["ValueError: format .xls is not supported: save it as .xlsx", "ValueError: format .exe is not supported", "ValueError: format  is not supported", "BadZipFile"]))
def file_errors(spark, sf_dir):
    """Files that can't be masked give a class of error and no content, and never text."""
    names = ["f{k}.xls", "f{k}.exe", "f{k}", "f{k}.docx"]
    rows = keyed(spark, sf_dir, "supplier", "s_suppkey", path=names, text=["Иванова А.Б. {k}"]).select("path", F.col("text").cast("binary").alias("content"))
    return files.mask_files(rows).select(F.regexp_extract("path", r"f(\d+)", 1).cast("long").alias("k"), "error")


_pages = ["## Страница 1\n\nпочта [EMAIL_1]\n\n---\n\n## Страница 2\n\nснова [EMAIL_1] и {k}"]


@query(answers("supplier", "s_suppkey", text=[_pages[0].replace("\n", "/")]))
def pdf_sections(spark, sf_dir):
    """Pages of a PDF, as the adapter gives them, in sections of one masked text."""
    rows = keyed(spark, sf_dir, "supplier", "s_suppkey", text=["почта c{k}@mail.ru|снова c{k}@mail.ru и {k}"])
    made = mapped(lambda t: formats.page_sections(t.split("|"), Masker().mask).replace("\n", "/"))
    return rows.select("k", made("text").alias("text"))


_markup = ['<P CLASS=x hidden>a{k}@x.ru<br/>&#169;&nbsp;</P>', "<!-- a@x.ru --><?pi a@x.ru?><![CDATA[a@x.ru]]>{k}", '<a href="mailto:a{k}@x.ru" title=\'t\'>тел 8 (499) 555-12-34</a>', "<script>b{k}@x.ru</script> < текст"]
_markup_kept = ['<P CLASS=x hidden>[EMAIL_1]<br/>&#169;&nbsp;</p>', "<!-- a@x.ru --><?pi a@x.ru?><![CDATA[a@x.ru]>{k}", '<a href="mailto:a{k}@x.ru" title=\'t\'>тел [ТЕЛЕФОН_1]</a>', "<script>[EMAIL_1]</script> < текст"]
_markup_even = ['<p class="x" hidden>[EMAIL_1]<br></br>&#169;&nbsp;</p>', _markup_kept[1], '<a href="mailto:a{k}@x.ru" title="t">тел [ТЕЛЕФОН_1]</a>', _markup_kept[3]]


@query(answers("supplier", "s_suppkey", kept=_markup_kept, even=_markup_even))
def html_markup(spark, sf_dir):
    """Only text nodes are masked; start tags stay as they were, or are written evenly."""
    rows = keyed(spark, sf_dir, "supplier", "s_suppkey", html=_markup)
    one = mapped(lambda t: formats.change_html_text(t, Masker().mask))
    two = mapped(lambda t: formats.change_html_text(t, Masker().mask, even=True))
    return rows.select("k", one("html").alias("kept"), two("html").alias("even"))


@query("SELECT k, n AS ord, '[EMAIL_' || n || ']' AS placeholder, 'c' || k || '_' || n || '@x.ru' AS original, 'EMAIL' AS type FROM (SELECT s_suppkey AS k, unnest(range(1, 4)) AS n FROM supplier)")
def key_files(spark, sf_dir):
    """The keys of many key files in their order."""
    one = lambda n: f'concat(\'"[EMAIL_{n}]": {{"original": "c\', cast(k as string), \'_{n}@x.ru", "type": "EMAIL"}}\')'
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey as k").selectExpr("k", f"concat('{{', {one(1)}, ', ', {one(2)}, ', ', {one(3)}, '}}') as value")
    return files.keys_parsed(rows, "value").select("k", F.col("ord").cast("long").alias("ord"), "placeholder", "original", "type")


@query("SELECT c_nationkey AS folder, 'ключи_20240101_' || lpad(cast(max(c_custkey) AS STRING), 6, '0') || '.json' AS newest FROM customer GROUP BY c_nationkey")
def newest_key_file(spark, sf_dir):
    """The newest key file of each folder, by its name; other files are none."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    name = F.concat(F.lit("ключи_20240101_"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"))
    each = rows.select(F.col("c_nationkey").alias("folder"), F.explode(F.array(F.concat(name, F.lit(".json")), F.concat(name, F.lit(".txt")), F.lit("яяя.json"))).alias("name"))
    return each.groupBy("folder").agg(files.newest_of(F.col("name")).alias("newest"))


# Layers.


def lexicon() -> L.Lexicon:
    return (
        L.Lexicon()
        .add("Морозова", "морозов", "Surn", "sing")
        .add("Сергеевич", "сергеевич", "Patr")
        .add("Роман", "роман", "Name")
        .add("Роман", "роман", "NOUN")
        .add("Смету", "смета", "NOUN", "sing")
        .add("Балансов", "баланс", "NOUN", "plur")
        .add("Рассчитайте", "рассчитать", "VERB")
    )


TAGGER = L.WordTagger({"Литвинов": "PER", "Ромашка": "ORG", "Созвон": "PER", "Смету": "PER", "Рассчитайте": "PER", "Москва": "LOC", "КМ-2024-0055": "ORG", "Ан": "PER", "Litvinov": "PER", "Орлова": "PER", "КАПС_1": "PER", "ФИО_1": "PER"})
_tagged = ["пришёл Литвинов, лот {k}", "Литвинов и Ромашка, лот {k}", "Созвон в {k}", "Рассчитайте {k}", "код КМ-2024-0055 и {k}", "Ан {k} тут", "Litvinov {k}", "Литвинов и Орлова {k}", "КАПС_1 и ИНН 5700123456, лот {k}", "Москва {k}", "Смету {k} Балансов", "[ФИО_1] был {k}"]
_tagged_masked = ["пришёл [ФИО_1], лот {k}", "[ФИО_1] и [КОМПАНИЯ_1], лот {k}", "Созвон в {k}", "Рассчитайте {k}", "код КМ-2024-0055 и {k}", "Ан {k} тут", "Litvinov {k}", "[ФИО_2] и [ФИО_1] {k}", "КАПС_1 и ИНН [ИНН_ЮЛ_1], лот {k}", "Москва {k}", "Смету {k} Балансов", "[ФИО_1] был {k}"]


@query(answers("customer", "c_custkey", text_masked=_tagged_masked))
def tagger_layer(spark, sf_dir):
    """Entities from the last to the first; stop words in any singular form, verbs, codes, short ones and placeholders' insides stay."""
    rows = keyed(spark, sf_dir, "customer", "c_custkey", text=_tagged)
    return M.mask(rows, "text", ("k",), config=Config(tagger=TAGGER, morphology=lexicon())).select("k", "text_masked")


_named = ["прислала Морозова смету {k}", "Роман с продолжением {k}", "был Сергеевич, {k}", "[Морозова] {k}", "Морозова_1 {k} Смету", "ИП Морозова Е.С. и Морозова {k}"]
_named_masked = ["прислала [ФИО_1] смету {k}", "Роман с продолжением {k}", "был [ФИО_1], {k}", "[Морозова] {k}", "Морозова_1 {k} Смету", "[КОМПАНИЯ_1] и [ФИО_1] {k}"]


@query(answers("customer", "c_custkey", text_masked=_named_masked))
def name_pass(spark, sf_dir):
    """Capitalised words that the morphology takes for names, after all other passes."""
    rows = keyed(spark, sf_dir, "customer", "c_custkey", text=_named)
    return M.mask(rows, "text", ("k",), config=Config(tagger=L.WordTagger({}), morphology=lexicon())).select("k", "text_masked")


_viewed = ["· Литвинов {k}", "- пункт {k}", "-пункт {k}", "ATOH и Power {k}", "us06web.zoom.us/j/A и K9A {k}", "a ОAО {k}", "x/y: CKOPO {k}"]
_views = ["  Литвинов {k}", "  пункт {k}", "-пункт {k}", "АТОН и Power {k}", "us06web.zoom.us/j/A и K9A {k}", "a ОАО {k}", "x/y: СКОРО {k}"]


@query(answers("customer", "c_custkey", view=_views))
def tagger_view(spark, sf_dir):
    """What the tagger reads: no list markers, look-alike letters repaired but in links and codes."""
    rows = keyed(spark, sf_dir, "customer", "c_custkey", text=_viewed)
    return rows.select("k", mapped(L.view)("text").alias("view"))


@query("SELECT k, length(t) >= 4 AND regexp_matches(t, '[А-Яа-яЁё]') AS is_read FROM (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'абв' WHEN 1 THEN 'abcdef' WHEN 2 THEN 'где ' || c_custkey ELSE '' END AS t FROM customer)")
def tagger_guard(spark, sf_dir):
    """Texts of four characters and a Cyrillic letter reach the tagger."""
    rows = keyed(spark, sf_dir, "customer", "c_custkey", text=["абв", "abcdef", "где {k}", ""])
    return rows.select("k", mapped(L.tagged, "boolean")("text").alias("is_read"))


_words = ["морозова", "сокол", "роман", "смету", "балансов", "рассчитайте", "мсфо", "общество", "неизвестно"]
_readings = [
    "array(named_struct('lemma', 'морозов', 'known', true, 'grammemes', array('Surn', 'sing')))",
    "array(named_struct('lemma', 'сокол', 'known', true, 'grammemes', array('NOUN')), named_struct('lemma', 'сокол', 'known', true, 'grammemes', array('Surn')))",
    "array(named_struct('lemma', 'роман', 'known', true, 'grammemes', array('Name')), named_struct('lemma', 'роман', 'known', true, 'grammemes', array('NOUN')))",
    "array(named_struct('lemma', 'смета', 'known', true, 'grammemes', array('NOUN', 'sing')))",
    "array(named_struct('lemma', 'баланс', 'known', true, 'grammemes', array('NOUN', 'plur')), named_struct('lemma', 'балансов', 'known', false, 'grammemes', array('Surn')))",
    "array(named_struct('lemma', 'рассчитать', 'known', true, 'grammemes', array('VERB')))",
    "array(named_struct('lemma', 'мсфо', 'known', false, 'grammemes', array('Surn')))",
    "array(named_struct('lemma', 'общество', 'known', true, 'grammemes', array('NOUN')))",
    "cast(array() as array<struct<lemma: string, known: boolean, grammemes: array<string>>>)",
]
_PREDICATES = {"personal": "1 1 0 0 1 0 1 0 0", "known_personal": "1 1 1 0 0 0 0 0 0", "stop_form": "0 0 0 1 0 0 1 1 0", "verb": "0 0 0 0 0 1 0 0 0", "stop_word": "0 0 0 1 0 0 1 1 0"}


def _flags(of: str) -> str:
    return "CASE k % 9 " + " ".join(f"WHEN {i} THEN {'true' if x == '1' else 'false'}" for i, x in enumerate(_PREDICATES[of].split())) + " END"


@query("SELECT k, " + ", ".join(f"{_flags(p)} AS {p}, {_flags(p)} AS {p}_py" for p in _PREDICATES) + " FROM (SELECT c_custkey AS k FROM customer)")
def morphology_predicates(spark, sf_dir):
    """Personal, known, stop-form, verb and stop-word, over a column of readings and by the workers' own functions."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey as k")
    pick = "CASE k % 9 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_readings)) + " END as p"
    rows = rows.selectExpr("k", case(_words) + " as w", pick)
    p, w = F.col("p"), F.col("w")
    columns = {"personal": L.personal_column(p), "known_personal": L.known_personal_column(p), "stop_form": L.stop_form_column(p), "verb": L.verb_column(p), "stop_word": L.stop_word_column(w, p)}

    class Given:
        def __init__(self, parses):
            self.parses = parses

        def parse(self, word):
            return self.parses

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parses = [[L.Parse(x["lemma"], x["known"], frozenset(x["grammemes"])) for x in row] for row in b.p]
            checks = {"personal": L.is_personal, "known_personal": L.is_known_personal, "stop_form": L.is_stop_form, "verb": L.is_verb}
            made = {f"{n}_py": [f(x) for x in parses] for n, f in checks.items()}
            made["stop_word_py"] = [L.is_stop_word(word, Given(x)) for word, x in zip(b.w, parses)]
            yield b.drop(columns=["p", "w"]).assign(**made)

    made = rows.select("k", "w", "p", *(c.alias(n) for n, c in columns.items()))
    return made.mapInPandas(run, "k long, " + ", ".join(f"{n} boolean" for n in columns) + ", " + ", ".join(f"{n}_py boolean" for n in columns))


# Service.


@query("SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN true WHEN 3 THEN true ELSE false END AS passed FROM conversations")
def bearer_tokens(spark, sf_dir):
    """Requests by their header: the scheme in any case, the token to the letter."""
    k = (F.col("conv_id") + F.col("turn")) % 6
    header = F.when(k == 0, "Bearer secret-token").when(k == 1, "Bearer secret-tokem").when(k == 2, "secret-token").when(k == 3, "bearer secret-token ").when(k == 4, "Basic secret-token")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", header.alias("header"))
    return rows.select("conv_id", "turn", R.authorised_column(F.col("header"), "secret-token").alias("passed"))


@query(answers("supplier", "s_suppkey", outcome=["a token is required", "a token is required", "the body limit must be a number of bytes", "the body limit must be above zero", "262144"]))
def service_settings(spark, sf_dir):
    """A service without a token or with a senseless limit doesn't start."""

    def outcome(case_: str) -> str:
        token, limit = case_.split("|")
        try:
            return str(R.check_settings(token or None, limit)[1])
        except RuntimeError as e:
            return str(e)

    rows = keyed(spark, sf_dir, "supplier", "s_suppkey", settings=["|1", "  |1", "t{k}|x", "t{k}|0", "t{k}|262144"])
    return rows.select("k", mapped(outcome)("settings").alias("outcome"))


@query("SELECT 503 AS code, 'degraded' AS status, false AS ready, 'not installed' AS ner_status, 'not installed' AS surnames_status, '2 entries' AS dictionary_status, '1.0.0' AS version, true AS has_fingerprint")
def health(spark, sf_dir):
    """Readiness of a service whose tagger and morphology are not installed."""
    from kryptonym.functions.dictionary import parse

    config, status = R.build_layers(tuple(parse(["Ромашка", "Юпитер | проект"])))
    h = R.health(config, status)
    row = [(h["code"], h["status"], h["ready"], h["ner_status"], h["surnames_status"], h["dictionary_status"], h["version"], h["fingerprint"])]
    out = spark.createDataFrame(row, "code int, status string, ready boolean, ner_status string, surnames_status string, dictionary_status string, version string, f string")
    return out.withColumn("has_fingerprint", F.col("f").rlike("^[0-9a-f]{12}$")).drop("f")


def _requests(spark, sf_dir) -> DataFrame:
    k = (F.col("conv_id") + F.col("turn")) % 3
    text = F.concat(F.lit("Почта c"), F.col("conv_id").cast("string"), F.lit("@mail.ru"))
    body = F.when(k == 0, F.to_json(F.struct(text.alias("text"), F.lit(False).alias("use_ner")))).when(k == 1, F.to_json(F.struct(text.alias("text")))).otherwise("{")
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", body.alias("body"))


@query("SELECT conv_id, turn, CASE (conv_id + turn) % 3 WHEN 0 THEN 200 WHEN 1 THEN 503 ELSE 400 END AS status, CASE (conv_id + turn) % 3 WHEN 0 THEN 'Почта [EMAIL_1]' END AS text FROM conversations")
def layer_refusals(spark, sf_dir):
    """A request that asks for a layer that isn't there is refused, never masked by less."""
    return R.anonymize(_requests(spark, sf_dir), Config()).select("conv_id", "turn", "status", "text")


@query("SELECT count(*) AS requests, sum(CASE WHEN (conv_id + turn) % 3 = 0 THEN 15 ELSE 0 END)::BIGINT AS chars, count(*) FILTER ((conv_id + turn) % 3 = 0) AS masks, count(*) FILTER ((conv_id + turn) % 3 <> 0) AS refused FROM conversations")
def request_counters(spark, sf_dir):
    """What is logged of requests: counts, never text."""
    return R.counted(R.anonymize(_requests(spark, sf_dir), Config()))


# Judges.


@query(answers("supplier", "s_suppkey", answer=["ДА: ТЕКСТ {k}", "НЕТ: ТЕКСТ {k}"]))
def judged_answers(spark, sf_dir):
    """A model's answers to a column of prompts, by a call of batches on the workers."""
    rows = keyed(spark, sf_dir, "supplier", "s_suppkey", prompt=["да: текст {k}", "нет: текст {k}"])
    return E.judged(rows, F.col("prompt"), lambda prompts: [p.upper() for p in prompts]).select("k", "answer")


@query("SELECT s_suppkey AS id, 'вывод ' || s_suppkey AS output, 'исходный ' || s_suppkey AS text FROM supplier WHERE s_suppkey % 2 = 0")
def rejudge_join(spark, sf_dir):
    """Stored outputs beside their corpus; outputs without a text are none."""
    rows = keyed(spark, sf_dir, "supplier", "s_suppkey", output=["вывод {k}"], text=["исходный {k}"])
    corpus = rows.where("k % 2 = 0").select(F.col("k").alias("id"), "text")
    return E.rejudged(rows.select(F.col("k").alias("id"), "output"), corpus).select("id", "output", "text")


@query(
    """
SELECT count(*) FILTER (quality = 1) AS positive, count(*) FILTER (toxic = 1 AND quality = 1) AS negative, count(*) FILTER (quality = 1) >= 8 AND count(*) FILTER (toxic = 1 AND quality = 1) <= 2 AS recognises,
    count(*) FILTER (quality = 0) AS own, count(*) FILTER (toxic = 1) AS other, count(*) FILTER (quality = 0) >= 9 AND count(*) FILTER (toxic = 1) <= 2 AS understands,
    count(*) FILTER (quality = 1) >= 8 AND count(*) FILTER (toxic = 1 AND quality = 1) <= 2 AND count(*) FILTER (quality = 0) >= 9 AND count(*) FILTER (toxic = 1) <= 2 AS passed FROM labels"""
)
def both_gates(spark, sf_dir):
    """A judge that has to pass the gate of recognition and that of meaning."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return E.both_gates(labels.select(q.alias("on_positive"), (q & t).alias("on_negative")), labels.select((~q).alias("own"), t.alias("other")))


@query("SELECT round(sum(s_suppkey / 10.0) / count(*), 2) AS seconds FROM supplier WHERE s_suppkey > (SELECT min(s_suppkey) FROM supplier)")
def warm_seconds(spark, sf_dir):
    """Mean seconds of all texts but the first."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") / 10.0).alias("seconds"))
    return E.warm_seconds(rows)


# The engine's edges.


@query(answers("customer", "c_custkey", text_masked=["тел [ТЕЛЕФОН_1], лот {k}", "тел [ТЕЛЕФОН_1] и [EMAIL_1]", "[EMAIL_1] й {k}"], _t=["своё {k}"], _m=["тоже {k}"], _k_phone=["и это {k}"]))
def native_edges(spark, sf_dir):
    """Spaced digits, letters to compose and columns of inner names, by built-in functions."""
    rows = keyed(spark, sf_dir, "customer", "c_custkey", text=["тел 8 9 1 6 1 2 3 4 5 6 7, лот {k}", "тел 8 (916) 123-45-67 и c{k}@x.ru", "c{k}@x.ru и\u0306 {k}"], _t=["своё {k}"], _m=["тоже {k}"], _k_phone=["и это {k}"])
    return M.native_masked(rows, "text", {"phone", "email"}).select("k", "text_masked", "_t", "_m", "_k_phone")


@query(answers("customer", "c_custkey", text_masked=["[EMAIL_1], лот {k}"], _m=["своё {k}"], _t=["тоже {k}"], _body=["и это {k}"]))
def inner_names(spark, sf_dir):
    """Columns of a table keep their values, whatever names the engine uses inside."""
    rows = keyed(spark, sf_dir, "customer", "c_custkey", text=["c{k}@x.ru, лот {k}"], _m=["своё {k}"], _t=["тоже {k}"], _body=["и это {k}"])
    return M.mask(rows, "text", ("k",)).select("k", "text_masked", "_m", "_t", "_body")


@query(answers("supplier", "s_suppkey", fresh=["[EMAIL_1]"], layers=["dictionary 1, tagger false, ready false"]))
def engine_settings(spark, sf_dir):
    """An engine is built from its settings and numbers anew for every text."""
    from kryptonym.functions.dictionary import parse

    config = Config(dictionary=tuple(parse(["Ромашка"])))
    told = f"dictionary {len(config.dictionary)}, tagger {str(config.tagger is not None).lower()}, ready {str(config.ready).lower()}"
    rows = keyed(spark, sf_dir, "supplier", "s_suppkey", text=["c{k}@x.ru"])
    return M.mask(rows, "text", ("k",), config=config).select("k", F.col("text_masked").alias("fresh"), F.lit(told).alias("layers"))
