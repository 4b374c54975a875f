"""name -> query, name -> DuckDB SQL of the masking engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kryptonym.functions import text as T
from kryptonym.functions.dictionary import parse, parsed
from kryptonym.functions.rules import BY_ID, registry_rows
from kryptonym.functions.text import squeezed
from kryptonym.operators import evaluate as E
from kryptonym.operators import mask as M
from kryptonym.operators import requests as R
from kryptonym.operators.masker import Config
from kryptonym.sources.files import html_masked

from . import golden
from .oracles import kernel
from .templates import TEMPLATES, expression

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _template_query(name: str):
    source, key, text, masked, originals = TEMPLATES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source).selectExpr(f"{key} as k").selectExpr("k", f"{expression(text)} as text")
        made = M.mask(rows, "text", ("k",))
        joined = F.array_join(F.transform("keys", lambda x: x["original"]), "|")
        return made.select("k", "text_masked", joined.alias("originals"), F.size("keys").alias("n_values"))

    values = expression("|".join(originals)) if originals else "''"
    QUERIES[name] = run
    ORACLES[name] = f"SELECT k, {expression(masked)} AS text_masked, {values} AS originals, {len(originals)} AS n_values FROM (SELECT {key} AS k FROM {source})"


for _name in TEMPLATES:
    _template_query(_name)

CONTACTS = ["phone", "email"]
_docs = kernel("SELECT doc_id, text FROM documents", "doc_id", CONTACTS)


@query(_docs + "\nSELECT doc_id, text_masked, len(known_phone) + len(known_email) AS n_values FROM masked")
def mask_documents(spark, sf_dir):
    """All default rules over the documents; they hold no identifiers but phones and e-mails."""
    made = M.mask(table(spark, sf_dir, "documents"), "text")
    return made.select("doc_id", "text_masked", F.size("keys").cast("long").alias("n_values"))


@query(_docs + "\nSELECT doc_id, text_masked, len(known_phone) + len(known_email) AS n_values FROM masked")
def mask_documents_native(spark, sf_dir):
    """Two rules by the kernel of built-in functions, without Python."""
    made = M.native_masked(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", set(CONTACTS))
    return made.select("doc_id", "text_masked", F.size("keys").cast("long").alias("n_values"))


def _keys_sql(rule: str) -> str:
    label = BY_ID[rule].label
    one = kernel("SELECT doc_id, text FROM documents", "doc_id", [rule])
    return one + f"\nSELECT doc_id, '[{label}_' || n || ']' AS placeholder, '{label}' AS type, original FROM (SELECT doc_id, unnest(known_{rule}) AS original, unnest(range(1, len(known_{rule}) + 1)) AS n FROM masked)"


def _keys_query(spark, sf_dir, rule):
    made = M.native_masked(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", {rule})
    return made.select("doc_id", F.explode("keys").alias("k")).select("doc_id", "k.placeholder", "k.type", "k.original")


@query(_keys_sql("email"))
def email_keys(spark, sf_dir):
    return _keys_query(spark, sf_dir, "email")


@query(_keys_sql("phone"))
def phone_keys(spark, sf_dir):
    return _keys_query(spark, sf_dir, "phone")


def _stats_sql(by: str) -> str:
    source = f"SELECT doc_id, {by}, text FROM documents" if by else "SELECT doc_id, text FROM documents"
    key = f"doc_id, {by}" if by else "doc_id"
    head, comma = (f"{by}, ", f"{by}, ") if by else ("", "")
    parts = []
    for r in CONTACTS:
        label = BY_ID[r].label
        parts.append(f"SELECT {comma}'{r}' AS type_id, '{label}' AS label, len(known_{r}) AS v, len(regexp_extract_all(text_masked, '\\[{label}_[0-9]+\\]')) AS s FROM masked WHERE len(known_{r}) > 0")
    return kernel(source, key, CONTACTS) + f"\nSELECT {head}type_id, label, sum(v)::BIGINT AS n_values, sum(s)::BIGINT AS n_replaced FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


def _stats(spark, sf_dir, by):
    made = M.mask(table(spark, sf_dir, "documents"), "text", config=Config(enabled=frozenset(CONTACTS)))
    return M.stats(made, by=by)


@query(_stats_sql(""))
def mask_stats_by_type(spark, sf_dir):
    return _stats(spark, sf_dir, ())


@query(_stats_sql("lang"))
def mask_by_lang(spark, sf_dir):
    return _stats(spark, sf_dir, ("lang",))


@query(_stats_sql("source"))
def mask_by_source(spark, sf_dir):
    return _stats(spark, sf_dir, ("source",))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS restored_sha256 FROM documents")
def restore_roundtrip(spark, sf_dir):
    """Masked and restored texts are the originals: the documents are composed and have no spaced digits."""
    made = M.restore(M.mask(table(spark, sf_dir, "documents"), "text"), "text_masked")
    return made.select("doc_id", F.sha2(F.coalesce("text_restored", F.lit("")).cast("binary"), 256).alias("restored_sha256"))


@query("SELECT c_custkey AS k, concat('кв. Иванова А.Б. ', cast(c_custkey AS STRING), ', снова Иванова А.Б.') AS text FROM customer")
def restore_nested(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    ph = F.concat(F.lit("кв. [ФИО_1] "), F.col("k").cast("string"))
    keys = F.array(F.struct(F.lit("[АДРЕС_1]").alias("placeholder"), ph.alias("original")), F.struct(F.lit("[ФИО_1]").alias("placeholder"), F.lit("Иванова А.Б.").alias("original")))
    return rows.select("k", M.restored(F.lit("[АДРЕС_1], снова [ФИО_1]"), keys).alias("text"))


_email = kernel("SELECT doc_id, text FROM documents", "doc_id", ["email"])


@query(
    _email
    + """
, each AS (SELECT doc_id, unnest(known_email) AS original, unnest(range(len(known_email))) AS pos FROM masked),
first AS (SELECT original, min((doc_id, pos)) AS place FROM each GROUP BY original)
SELECT '[EMAIL_' || row_number() OVER (ORDER BY place) || ']' AS placeholder, original FROM first"""
)
def batch_numbering(spark, sf_dir):
    """Key table of all documents numbered together, in the order of doc_id and place."""
    made = M.mask(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ("doc_id",), "batch", config=Config(enabled=frozenset({"email"})))
    return M.key_table(made).select("placeholder", "original")


@query(
    _email
    + """
, each AS (SELECT doc_id, unnest(known_email) AS original, unnest(range(len(known_email))) AS pos FROM masked),
first AS (SELECT original, row_number() OVER (ORDER BY min((doc_id, pos))) AS n FROM each GROUP BY original),
named AS (SELECT doc_id, list('[EMAIL_' || n || ']' ORDER BY pos) AS names FROM each JOIN first USING (original) GROUP BY doc_id)
SELECT doc_id, coalesce(array_to_string(list_transform(range(1, len(string_split_regex(text_masked, '\\[EMAIL_[0-9]+\\]')) + 1),
    lambda i: string_split_regex(text_masked, '\\[EMAIL_[0-9]+\\]')[i] || coalesce(names[cast(regexp_extract_all(text_masked, '\\[EMAIL_([0-9]+)\\]', 1)[i] AS INT)], '')), ''), text_masked) AS text_masked
FROM masked LEFT JOIN named USING (doc_id)"""
)
def batch_masking(spark, sf_dir):
    made = M.mask(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ("doc_id",), "batch", config=Config(enabled=frozenset({"email"})))
    return made.select("doc_id", "text_masked")


@query(
    """
WITH said AS (SELECT conv_id, turn, 'u' || ((conv_id + turn) % 3) || '@mail.ru' AS value FROM conversations),
first AS (SELECT conv_id, value, min(turn) AS place FROM said GROUP BY ALL),
n AS (SELECT conv_id, value, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS n FROM first)
SELECT conv_id, turn, 'пишите [EMAIL_' || n || ']' AS text_masked FROM said JOIN n USING (conv_id, value)"""
)
def group_numbering(spark, sf_dir):
    """Turns of a conversation share numbers."""
    value = F.concat(F.lit("пишите u"), ((F.col("conv_id") + F.col("turn")) % 3).cast("string"), F.lit("@mail.ru"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", value.alias("text"))
    return M.mask(rows, "text", ("turn",), "group", ("conv_id",)).select("conv_id", "turn", "text_masked")


_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
_TAG = r"<!--(?s:.)*?-->|</?[A-Za-z!][^>]*>"


@query(
    f"""
WITH nodes AS (SELECT page_id, html, regexp_replace(html, '{_TAG}', chr(1), 'g') AS inside FROM pages)
SELECT page_id, len(list_distinct(regexp_extract_all(inside, '{_EMAIL}'))) AS n_values, sha256(regexp_replace(inside, '{_EMAIL}', '@', 'g')) AS text_sha256,
    len(regexp_extract_all(html, '{_TAG}')) AS n_tags
FROM nodes"""
)
def html_text_mask(spark, sf_dir):
    """Pages whose text nodes lose their e-mails; all markup stays, e-mails in it too."""
    made = html_masked(table(spark, sf_dir, "pages"), "html", Config(enabled=frozenset({"email"})))
    inside = F.regexp_replace(F.regexp_replace("text_masked", _TAG, "\x01"), r"\[EMAIL_\d+\]", "@")
    tags = F.size(F.regexp_extract_all("text_masked", F.lit(_TAG), F.lit(0))).cast("long")
    return made.select("page_id", F.size("keys").cast("long").alias("n_values"), F.sha2(inside.cast("binary"), 256).alias("text_sha256"), tags.alias("n_tags"))


@query(
    """
WITH m AS (SELECT page_id, regexp_extract_all(html, '\\b[0-9]{10}\\b') AS l FROM pages)
SELECT page_id, len(list_distinct(l)) AS n_ids, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), '|') AS ids FROM m"""
)
def digit_ids_pages(spark, sf_dir):
    """Bare ten-digit numbers of raw pages as tax numbers, each once, in their order."""
    made = M.mask(table(spark, sf_dir, "pages"), "html", ("page_id",), config=Config(enabled=frozenset({"inn_ul"})))
    return made.select("page_id", F.size("keys").cast("long").alias("n_ids"), F.array_join(F.transform("keys", lambda k: k["original"]), "|").alias("ids"))


@query(
    """
SELECT o_orderkey AS k, 'Сумма [СУММА_1] от [ДАТА_1] и [ДАТА_2]' AS text_masked,
    concat(cast(o_orderkey AS STRING), ' руб', '|', '0', cast(1 + o_orderkey % 9 AS STRING), '.07.2024', '|', '3 марта 2024') AS originals
FROM orders"""
)
def amounts_and_dates(spark, sf_dir):
    """The two rules that are off by default."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), F.concat(F.lit("Сумма "), k.cast("string"), F.lit(" руб от 0"), (1 + k % 9).cast("string"), F.lit(".07.2024 и 3 марта 2024")).alias("text"))
    made = M.mask(rows, "text", ("k",), config=Config(enabled=frozenset({"amount", "date"})))
    return made.select("k", "text_masked", F.array_join(F.transform("keys", lambda x: x["original"]), "|").alias("originals"))


@query("SELECT c_custkey AS k, lpad(cast(c_custkey AS STRING), 10, '7') || ' x' AS text FROM customer")
def collapse_digits(spark, sf_dir):
    digits = F.lpad(F.col("c_custkey").cast("string"), 10, "7")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.array_join(F.split(digits, ""), " "), F.lit(" x")).alias("text"))
    return rows.select("k", T.collapse_digits(F.col("text")).alias("text"))


@query("SELECT c_custkey AS k, concat('77', lpad(cast(c_custkey AS STRING), 8, '0'), ' ', '4070', lpad(cast(c_custkey AS STRING), 16, '0')) AS text FROM customer")
def split_joined_fields(spark, sf_dir):
    """Thirty spaced digits are a tax number and an account."""
    k = F.col("c_custkey").cast("string")
    digits = F.concat(F.lit("77"), F.lpad(k, 8, "0"), F.lit("4070"), F.lpad(k, 16, "0"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.array_join(F.split(digits, ""), " ").alias("text"))
    return rows.select("k", T.collapse_digits(F.col("text")).alias("text"))


@query("SELECT s_suppkey AS k, nfc_normalize('Андрей ' || cast(s_suppkey AS STRING)) AS text_masked FROM supplier")
def nfc(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("Андрей "), F.col("s_suppkey").cast("string")).alias("text"))
    return M.mask(rows, "text", ("k",)).select("k", "text_masked")


DICTIONARY = ["# клиенты", "Ромашка", "Ромашка Трейд", "NordLight | проект", "аб"]


@query(
    """
SELECT s_suppkey AS k, concat('[КОМПАНИЯ_1], [КОМПАНИЯ_2] и [ПРОЕКТ_1], лот ', cast(s_suppkey AS STRING)) AS text_masked, 'Ромашкой Трейд|nordlight|Ромашке' AS originals FROM supplier"""
)
def dictionary_mask(spark, sf_dir):
    """Dictionary values in any inflection, the longest first."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("Ромашкой Трейд, Ромашке и nordlight, лот "), F.col("s_suppkey").cast("string")).alias("text"))
    made = M.mask(rows, "text", ("k",), config=Config(dictionary=tuple(parse(DICTIONARY))))
    return made.select("k", "text_masked", F.array_join(F.transform("keys", lambda x: x["original"]), "|").alias("originals"))


@query("SELECT concat(p_name, ' ', cast(p_partkey AS STRING)) AS value, CASE p_partkey % 3 WHEN 0 THEN 'КОМПАНИЯ' WHEN 1 THEN 'ФИО' ELSE 'МАРКА' END AS label, CASE p_partkey % 3 WHEN 0 THEN 'company' WHEN 1 THEN 'fio' ELSE 'марка' END AS type_id FROM part")
def dictionary_parse(spark, sf_dir):
    k = F.col("p_partkey")
    label = F.when(k % 3 == 0, "").when(k % 3 == 1, " | фио").otherwise("| Марка ")
    lines = table(spark, sf_dir, "part").select(F.concat(F.lit("  "), F.col("p_name"), F.lit(" "), k.cast("string"), label).alias("line"))
    return parsed(lines.union(spark.createDataFrame([("# нет",), ("  ",), ("аб",)], "line string")), "line")


#: The order in which the rules run, with the number of their forms; those off by default, and those that know no case.
_RULES = [
    ("company", "КОМПАНИЯ", 5), ("project", "ПРОЕКТ", 1), ("egrn", "ЕГРН", 1), ("kadastr", "КАДАСТР", 1), ("fio", "ФИО", 3), ("passport_issued", "ВЫДАН", 1), ("passport", "ПАСПОРТ", 1),
    ("snils", "СНИЛС", 2), ("podrazd", "КОД_ПОДР", 1), ("date_birth", "ДР", 1), ("date_issue", "ДАТА_ВЫДАЧИ", 1), ("place_birth", "МЕСТО_РОЖДЕНИЯ", 1), ("address", "АДРЕС", 4),
    ("account", "СЧЁТ", 2), ("ogrn", "ОГРН", 3), ("inn_fl", "ИНН_ФЛ", 2), ("inn_ul", "ИНН_ЮЛ", 2), ("kpp", "КПП", 1), ("bik", "БИК", 2), ("swift", "SWIFT", 1),
    ("phone", "ТЕЛЕФОН", 2), ("email", "EMAIL", 1), ("website", "САЙТ", 1), ("amount", "СУММА", 1), ("date", "ДАТА", 2),
]
_OFF, _ANY_CASE = ("amount", "date"), ("project", "swift", "email", "amount", "date")


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{a}', '{b}', {n}::BIGINT, {str(a in _ANY_CASE).lower()}, {str(a not in _OFF).lower()})" for i, (a, b, n) in enumerate(_RULES)) + ") AS t(rule_ord, id, label, forms, any_case, enabled)")
def rule_registry(spark, sf_dir):
    """The engine's rules, against a list written down by itself."""
    rows = [(i, j, a, b, c, d) for i, j, a, b, _, c, d in registry_rows()]
    forms = spark.createDataFrame(rows, "rule_ord int, form_ord int, id string, label string, any_case boolean, enabled boolean")
    return forms.groupBy("rule_ord", "id", "label", "any_case", "enabled").agg(F.count("*").alias("forms"))


def _scored(spark, sf_dir):
    """E-mails must go, the first line must stay."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    masked = M.mask(docs, "text", config=Config(enabled=frozenset({"email"})))
    must_go = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"), F.lit(0)))
    corpus = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("grp"), "text", must_go.alias("must_mask"), F.array(F.split_part("text", F.lit(" "), F.lit(1))).alias("must_stay"))
    # one masking, shown as two runs that differ in white space
    both = F.explode(F.array(*(F.struct(F.lit(n).alias("run"), F.concat("text_masked", F.lit(end)).alias("output")) for n, end in ((1, ""), (2, "\n")))))
    runs = masked.select(F.col("doc_id").alias("id"), both.alias("r")).select("id", "r.run", "r.output")
    return E.scored(corpus, runs)


_scores_sql = (
    _email
    + r"""
, corpus AS (SELECT doc_id, lang, text_masked AS out, list_distinct(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')) AS must, split_part(text, ' ', 1) AS stay FROM documents JOIN masked USING (doc_id)),
scores AS (SELECT doc_id, lang, len(must) AS need,
    len(list_filter(must, lambda s: NOT list_bool_and(list_append(list_transform(list_filter(regexp_extract_all(s, '[А-Яа-яЁёA-Za-z]{4,}|[0-9]{3,}'), lambda t: NOT list_contains(['www', 'http', 'https', 'mail', 'email'], lower(t))), lambda t: NOT contains(lower(out), lower(t))), true)))) AS missed,
    CASE WHEN contains(lower(trim(regexp_replace(out, '\s+', ' ', 'g'))), lower(trim(regexp_replace(stay, '\s+', ' ', 'g')))) THEN 0 ELSE 1 END AS alarms FROM corpus)"""
)


@query(_scores_sql + "\nSELECT lang AS grp, sum(need)::BIGINT AS spans, sum(missed)::BIGINT AS missed, round((sum(need) - sum(missed)) / nullif(sum(need), 0), 3) AS recall, sum(alarms)::BIGINT AS false_alarms, count(*) AS texts, count(*) AS preserved, count(*) AS reproducible FROM scores GROUP BY lang")
def leak_recall(spark, sf_dir):
    """Recall of masking, over-masking, preservation and reproducibility by language."""
    return E.summary(_scored(spark, sf_dir))


@query(_scores_sql + "\nSELECT doc_id AS id, need AS n_spans, missed AS n_missed, alarms AS n_false_alarms, true AS preserved, true AS reproducible FROM scores")
def text_scores(spark, sf_dir):
    out = _scored(spark, sf_dir)
    return out.select("id", F.col("n_spans").cast("long").alias("n_spans"), F.size("missed").cast("long").alias("n_missed"), F.size("false_alarms").alias("n_false_alarms"), "preserved", "reproducible")


@query("SELECT doc_id, doc_id % 3 <> 1 AS kept, CASE WHEN doc_id % 3 = 1 THEN 'совсем другое' ELSE '' END AS broken_at FROM documents")
def preservation_check(spark, sf_dir):
    """Every third text has a piece that its original lacks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("начало иванов середина "), F.col("doc_id").cast("string"), F.lit(" конец")).alias("text"))
    piece = F.when(F.col("doc_id") % 3 == 1, "совсем другое").otherwise("середина")
    out = docs.withColumn("out", F.concat(F.lit("начало [ФИО_1]\n"), piece, F.lit(" [ДАТА_1] конец")))
    p = E.preservation(F.col("text"), F.col("out"))
    return out.select("doc_id", p["kept"].alias("kept"), p["broken_at"].alias("broken_at"))


@query("SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS text FROM documents")
def whitespace_normalised(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", squeezed(F.coalesce("text", F.lit(""))).alias("text"))


@query("SELECT doc_id, 6.0 / (6 + len(cast(doc_id % 7 AS STRING) || 'ab')- 1) AS share, 6.0 / (6 + len(cast(doc_id % 7 AS STRING) || 'ab') - 1) >= 0.9 AS is_russian FROM documents")
def cyrillic_share(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("привет"), (F.col("doc_id") % 7).cast("string"), F.lit("ab!")).alias("t"))
    share = E.cyrillic_share(F.col("t"))
    return rows.select("doc_id", share.alias("share"), (share >= E.CYRILLIC_SHARE).alias("is_russian"))


@query("SELECT count(*) FILTER (quality = 1) AS positive, count(*) FILTER (toxic = 1) AS negative, count(*) FILTER (quality = 1) >= 8 AND count(*) FILTER (toxic = 1) <= 2 AS passed FROM labels")
def judge_gate(spark, sf_dir):
    return E.judge_gate(table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("on_positive"), (F.col("toxic") == 1).alias("on_negative")))


@query("SELECT count(*) FILTER (quality = 1) AS own, count(*) FILTER (toxic = 1) AS other, count(*) FILTER (quality = 1) >= 9 AND count(*) FILTER (toxic = 1) <= 2 AS passed FROM labels")
def meaning_gate(spark, sf_dir):
    return E.meaning_gate(table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("own"), (F.col("toxic") == 1).alias("other")))


@query(
    """
SELECT count(*) FILTER (quality = 1) AS masked, count(*) FILTER (toxic = 1) AS abstract, count(*) FILTER (quality = 1 AND toxic = 0) AS meaning,
    count(*) FILTER (toxic = 1) <= count(*) FILTER (quality = 1) - 2 AS fewer_recognised, count(*) FILTER (quality = 1 AND toxic = 0) >= 8 AS meaning_kept,
    count(*) FILTER (toxic = 1) <= count(*) FILTER (quality = 1) - 2 AND count(*) FILTER (quality = 1 AND toxic = 0) >= 8 AS accepted
FROM labels"""
)
def gate_verdict(spark, sf_dir):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return E.verdict(table(spark, sf_dir, "labels").select(q.alias("recognised_masked"), t.alias("recognised_abstract"), (q & ~t).alias("meaning_abstract")))


@query("SELECT doc_id, n_chars AS thesis, coalesce(lead(n_chars) OVER w, first_value(n_chars) OVER w) AS next_thesis FROM documents WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def thesis_shift(spark, sf_dir):
    return E.next_thesis(table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("thesis")), "doc_id", "thesis")


@query("SELECT doc_id, CASE WHEN doc_id % 9 BETWEEN 1 AND 5 THEN (doc_id % 9)::INT ELSE 0 END AS candidate, doc_id % 2 = 0 AS yes FROM documents")
def judge_answers(spark, sf_dir):
    """Numbers and yes-or-no answers of a judge, read from its words."""
    answer = F.concat(F.lit("Кандидат "), (F.col("doc_id") % 9).cast("string"), F.lit(", не 77"))
    yes = F.when(F.col("doc_id") % 2 == 0, " да, сохранён").otherwise("нет")
    return table(spark, sf_dir, "documents").select("doc_id", E.recognised_number(answer, 5).alias("candidate"), E.says_yes(yes).alias("yes"))


@query(
    """
SELECT conv_id, turn, CASE (conv_id + turn) % 7 WHEN 0 THEN 200 WHEN 3 THEN 400 WHEN 6 THEN 413 ELSE 422 END AS status,
    CASE (conv_id + turn) % 7 WHEN 1 THEN 'use_ner: boolean_type' WHEN 2 THEN 'junk: extra_forbidden' WHEN 5 THEN 'text: missing' ELSE '' END AS errors
FROM conversations"""
)
def request_validation(spark, sf_dir):
    k = (F.col("conv_id") + F.col("turn")) % 7
    body = (
        F.when(k == 0, F.to_json(F.struct("text", F.lit(False).alias("use_ner"))))
        .when(k == 1, '{"text": "a", "use_ner": "yes"}')
        .when(k == 2, '{"text": "a", "junk": 1}')
        .when(k == 3, '{"text": ')
        .when(k == 4, "[1, 2]")
        .when(k == 5, '{"use_dict": true}')
        .otherwise(F.concat(F.lit('{"text": "'), F.repeat(F.lit("x"), R.MAX_BODY), F.lit('"}')))
    )
    out = R.validated(table(spark, sf_dir, "conversations").withColumn("body", body))
    return out.select("conv_id", "turn", "status", F.array_join("errors", "|").alias("errors"))


@query("SELECT conv_id, turn, 200 AS status, 'Почта [EMAIL_1]' AS text, 1 AS total, 1 AS n_emails FROM conversations")
def anonymize_requests(spark, sf_dir):
    text = F.concat(F.lit("Почта c"), F.col("conv_id").cast("string"), F.lit("@mail.ru"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct(text.alias("text"), F.lit(False).alias("use_ner"))).alias("body"))
    return R.anonymize(rows, Config()).select("conv_id", "turn", "status", "text", "total", F.col("by_type")["email"].alias("n_emails"))


@query("SELECT conv_id, turn, 200 AS status, concat('Почта c', cast(conv_id AS STRING), '@mail.ru') AS text FROM conversations")
def restore_requests(spark, sf_dir):
    keys = F.create_map(F.lit("[EMAIL_1]"), F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("@mail.ru")).alias("original"), F.lit("EMAIL").alias("type")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.lit("Почта [EMAIL_1]").alias("text"), keys.alias("keys"))).alias("body"))
    return R.restore_requests(rows).select("conv_id", "turn", "status", "text")


@query("SELECT conv_id, turn, CASE WHEN 12 + (conv_id * 7 + turn) % 400 > 200 THEN 413 ELSE 200 END AS status FROM conversations")
def reject_oversize(spark, sf_dir):
    """Bodies over the limit are refused unread."""
    body = F.concat(F.lit('{"text": "'), F.repeat(F.lit("x"), ((F.col("conv_id") * 7 + F.col("turn")) % 400).cast("int")), F.lit('"}'))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("body"))
    return R.validated(rows, limit=200).select("conv_id", "turn", "status")


QUERIES |= golden.QUERIES
ORACLES |= golden.ORACLES
