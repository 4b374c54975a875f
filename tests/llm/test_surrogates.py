import re

import pytest

from kryptonym.llm import queries
from kryptonym.llm import surrogates as S

TEXT = "Mr. John Smith (john.smith@mail.example.com, JOHN.SMITH@MAIL.EXAMPLE.COM) rang +1 (988) 555-2485 and 988-555-2485 from 42.144.35.254; card 4111 1111 1111 1111, SSN 123-45-6789, IBAN DE89 3704 0044 0532 0130 00. Smith paid. Frau Anna Weber; Иван Петров."


def kinds(text):
    return [k for *_, k, _ in S.mentions(text)]


def test_mentions():
    assert [TEXT[a:b] for a, b, k, _ in S.mentions(TEXT) if k == "phone"] == ["+1 (988) 555-2485", "988-555-2485"]
    assert len({v for *_, k, v in S.mentions(TEXT) if k == "phone"}) == 1
    assert [k for k in kinds(TEXT)] == ["given_m", "family", "email", "email", "phone", "phone", "ip", "card", "ssn", "iban", "family", "given_f", "family", "given_m", "family"]
    assert kinds("4451718024887799 27.65.93.188 +1 (836) 555-9331 42.101.3.4 988 42.144.35.254 +1 (269) 555-3296 4524132264652876") == ["card", "ip", "phone", "ip", "ip", "phone", "card"]
    assert kinds("version 1.2.3.4.5, 2024-01-02, $1,000.00, 12:30:45, The The") == []


def test_types_and_formats():
    out, _ = S.replaced(TEXT, b"k", {})
    for _, _, k, _ in S.mentions(TEXT):
        assert k in kinds(out)
    for original in ("john.smith", "988", "42.144", "4111 1111", "123-45", "3704", "John", "Weber", "Иван", "Петров"):
        assert original.lower() not in out.lower()
    phones = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\d)] )\b\d{3}-\d{3}-\d{4}", out)
    assert len(phones) == 2 and re.sub(r"\D", "", phones[0])[-10:] == re.sub(r"\D", "", phones[1])
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4}),", out)[1].replace(" ", "")
    assert card[0] == "4" and S.luhn(card) == 0
    mails = re.findall(r"[\w.]+@[\w.]+\w", out)
    assert mails[0].lower() == mails[1].lower() and mails[1].isupper() and mails[0].endswith(".com")
    given = re.search(r"Mr\. (\w+)", out)[1].lower()
    assert any(given.endswith(x) for x in S.LATIN["given_m"]) and any(re.search(r"Frau (\w+)", out)[1].endswith(x) for x in S.LATIN["given_f"])
    family = re.search(r"Mr\. \w+ (\w+)", out)[1]
    assert f"{family} paid" in out and S.iban_rest(re.search(r"IBAN ([A-Z0-9 ]+)\.", out)[1].replace(" ", "")) == 1
    assert re.search(r"; ([А-Яа-яё]+) ([А-Яа-яё]+)\.$", out)
    assert S.replaced(TEXT, b"other", {})[0] != out == S.replaced(TEXT, b"k", {})[0]


@pytest.fixture(scope="module")
def crowd(spark):
    names = [f"{chr(65 + i % 26)}{chr(97 + i // 26)}sson" for i in range(120)]
    return spark.createDataFrame([(i, f"Mr. {n} at 10.0.{i % 250}.{i} and Mr. {n}") for i, n in enumerate(names)], "doc_id long, text string")


def test_distinct_and_coreferent(spark, crowd):
    rows = S.pseudonymise(crowd, b"k").collect()
    pairs = [re.findall(r"Mr\. ([\w-]+)", r.text) for r in rows]
    assert all(a == b for a, b in pairs) and len({a for a, _ in pairs}) == 120
    originals = {n for t in crowd.collect() for n in re.findall(r"Mr\. (\w+)", t.text)}
    assert not originals & {a for a, _ in pairs}
    assert rows[0].n_entities == 3 and rows[0].n_family == 2 and rows[0].n_ip == 1
    again = S.pseudonymise(crowd.repartition(7), b"k").collect()
    assert sorted(tuple(r) for r in again) == sorted(tuple(r) for r in rows)


def test_rows(spark):
    data = [(1, None), (2, ""), (3, "a@b.com " * 20_000), (3, "A@b.com"), (None, "a@b.com"), (4, "nothing here 😀"), (5, "é a@b.com é")]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as n_email", "2 as id", "3 as again", "4 as kind")
    out = S.pseudonymise(df, b"k").collect()
    assert sorted(((r.doc_id or 0), r.n_email) for r in out) == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 20_000), (4, 0), (5, 1)]
    made = {m.lower() for r in out for m in re.findall(r"[\w.]+@[\w.]+", r.text)}
    assert len(made) == 1 and made != {"a@b.com"}
    assert S.pseudonymise(df.limit(0), b"k").count() == 0


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    mails = set()
    for r in queries.QUERIES["op9_surrogates"](spark, sf).collect():
        found = set(re.findall(r"[\w.]+@[\w.]+\w", docs[r.doc_id]))
        mails |= found
        assert not any(m in r.text for m in found)
        assert kinds(r.text) == kinds(docs[r.doc_id]) and len(kinds(r.text)) == r.n_entities
    assert mails


def test_hint_misses_no_mention():
    """Names beside any quote, dash or space are read, so are other digits and IBANs of two digits."""
    import pyarrow as pa

    bare = ["Mary Smith", "Иван Петров", "Monsieur Dupont", "Mr. Brown", "GB12ABCDEFGHIJKL", "١٢٣-٤٥٦-٧٨٩٠"]
    texts = [f"{a}{x}{b}" for x in bare for a, b in ("“”", "«»", "‘’", "——", "  ", "()", "„“", "，。")]
    assert all(S.mentions(x) for x in texts)
    assert S.worth_reading(pa.array(texts)).all()
    assert not S.worth_reading(pa.array(["", "nothing here 123", "«»"])).any()


def test_permutation_is_one_to_one():
    for n in (1, 2, 3, 26, 100, 1000):
        keyed = S.Keyed(b"k", n)
        assert sorted(keyed.permuted(x, n) for x in range(n)) == list(range(n))


CROWDED = (
    [("email", f"{chr(97 + i)}@x.com") for i in range(26)]
    + [("email", f"{chr(97 + i)}@{chr(97 + j)}.com") for i in range(3) for j in range(26)]
    + [("family", x) for x in ("smith", "иванова", "о'нил", "anna-lena")]
    + [("ssn", f"{i:09d}") for i in range(50)]
    + [("ip", f"10.0.0.{i}") for i in range(50)]
    + [("card", "4111111111111111"), ("card", "4111111111111112"), ("iban", "DE89370400440532013000"), ("iban", "DE88370400440532013000")]
    + [("given_f", "mary"), ("given_m", "mary"), ("given_n", "wei"), ("phone", "9885552485"), ("phone", "0885552485")]
)


def plain_rounds(entities):
    """The rounds one after the other, without Spark."""
    kind_of = lambda k: "given" if k.startswith("given") else k
    tries = dict.fromkeys(entities, 0)
    real = {(kind_of(k), v) for k, v in entities}
    while True:
        wants = {}
        for (k, v), a in tries.items():
            wants.setdefault((kind_of(k), S.surrogate(b"k", k, v, a)), []).append((a, v, k))
        again = [(k, v) for made, who in wants.items() for a, v, k in who if made in real or (a, v, k) != min(who)]
        if not again:
            return tries
        for x in again:
            tries[x] += 1


@pytest.mark.parametrize("hot", (1, 4096))
def test_rounds_against_plain_ones(spark, monkeypatch, hot):
    """Formats that are as full as they can be: no surrogate is an original, and all are distinct."""
    from kryptonym.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", hot)
    found = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(CROWDED * 2)], "id long, kind string, value string")
    got = {(r.kind, r.value): r.attempt for r in S.attempts_of(found, b"k").collect()}
    assert got == plain_rounds(sorted(set(CROWDED)))
    made = [(k.split("_")[0], S.surrogate(b"k", k, v, a)) for (k, v), a in got.items()]
    assert len(set(made)) == len(made) and not {m for _, m in made} & {v for _, v in CROWDED}


def test_one_letter_mailboxes(spark):
    df = spark.createDataFrame([(i, f"{chr(97 + i)}@x.com wrote") for i in range(26)], "doc_id long, text string")
    texts = {r.text for r in S.pseudonymise(df, b"k").collect()}
    assert len(texts) == 26 and all(re.fullmatch(r"[a-z]+@[a-z]\.com wrote", t) for t in texts)
    with pytest.raises(ValueError):
        S.pseudonymise(df, b"")


def test_full_formats_grow():
    tries = plain_rounds([("ssn", v) for v in ("1", "2", "3", "4", "5", "6", "7", "8", "9", "0")] + [("email", f"{c}@x.com") for c in "abcdefghijklmnopqrstuvwxyz"])
    assert {len(S.surrogate(b"k", k, v, a)) for (k, v), a in tries.items() if k == "ssn"} > {1} or max(tries.values()) > 1


def test_valid_numbers_stay_valid():
    for attempt in range(4):
        assert S.luhn(S.surrogate(b"k", "card", "4111111111111111", attempt)) == 0
        made = S.surrogate(b"k", "iban", "GB82WEST12345698765432", attempt)
        assert made[:2] == "GB" and S.iban_rest(made) == 1 and made[4:8].isalpha()
        assert S.surrogate(b"k", "iban", "GB83WEST12345698765432", attempt)[2:4] == "83"


NAMES = [
    ("My name is Priya Sharma and", ["Priya", "Sharma"]),
    ("Dear Wei,", ["Wei"]),
    ("Name: Liam O'Neill", ["Liam", "O'Neill"]),
    ("from Ana María <ana@x.com>", ["Ana", "María"]),
    ("Wei Zhang (wei.zhang@x.com) said", ["Wei", "Zhang"]),
    ("Mr. van der Berg", []),
    ("Dr. Carla van der Berg met", ["Carla", "Berg"]),
    ("Kind regards,\nTomasz Nowak", ["Tomasz", "Nowak"]),
    ("Меня зовут Анна Петрова.", ["Анна", "Петрова"]),
    ("Mrs. McDonald rang. McDonald left.", ["McDonald", "McDonald"]),
    ("The Name Is Nothing. Dear all, name is not", []),
]


@pytest.mark.parametrize("text,names", NAMES)
def test_names_by_what_stands_around_them(text, names):
    import pyarrow as pa

    assert [text[a:b] for a, b, k, _ in S.mentions(text) if k not in ("email",)] == names
    assert not names or S.worth_reading(pa.array([text])).all()


def test_a_million_family_names():
    """Distinct surrogates for as many names as a large table has, within few attempts."""
    left, taken, attempt = [f"name{i}" for i in range(1_000_000)], set(), 0
    while left:
        lost = []
        for x in left:
            made = S.surrogate(b"k", "family", x, attempt)
            (lost.append(x) if made in taken else taken.add(made))
        left, attempt = lost, attempt + 1
    assert len(taken) == 1_000_000 and attempt <= 5
