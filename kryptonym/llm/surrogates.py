"""PII surrogates: keyed, type-consistent replacements, distinct across the whole table."""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, blocks, checkpointed, gathered, joined_hot, prepare

KINDS = ("email", "phone", "card", "ip", "iban", "ssn", "given_f", "given_m", "given_n", "family")

EMAIL = r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
IBAN = r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
CARD = r"(?P<card>(?<![\w.+-])(?:\d{4}(?P<sep>[ -])\d{4}(?P=sep)\d{4}(?P=sep)\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\w-]))"
SSN = r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
IP = r"(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d))"
PHONE = r"(?P<phone>(?<![\w.])(?:(?:\+\d{1,3}[ -]?)?(?:\(\d{2,4}\)[ -]?|\d{2,4}[ -])\d{2,4}(?:[ -]\d{2,4}){1,3}|\+\d{9,14}|(?:\+\d{1,3}\.)?\d{3}\.\d{3}\.\d{4})(?![\w-]|\.\d))"
CONTACT = re.compile("|".join((EMAIL, IBAN, SSN, IP, CARD, PHONE)))

#: Given names whose gender is known; any other given name is of gender n. They begin a full name wherever they stand.
GIVEN_F = "Mary Anna Emma Laura Julia Sarah Alice Clara Helen Maria Sofia Marie Camille Elise Ingrid Greta Heidi Lucia Carmen Elena Nina Olivia Paula Rosa Vera Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана Юлия Вера".split()
GIVEN_M = "John James Peter Paul Thomas Martin David Simon Oscar Hugo Louis Pierre Jean Karl Hans Fritz Jorge Carlos Pablo Luis Felix Victor Walter Henry Robert Иван Пётр Сергей Алексей Дмитрий Андрей Михаил Николай Павел Олег".split()
_KNOWN = {w: "given_f" for w in GIVEN_F} | {w: "given_m" for w in GIVEN_M}
TITLES = {"Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Don": "m", "Sir": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Dr": "n", "Prof": "n"}
#: Words after which a person's name stands, whatever the name.
CUES = ["my name is", "My name is", "his name is", "her name is", "Her name is", "His name is", "Name:", "name:", "Author:", "Contact:", "Attn:", "Signed:", "signed by", "Signed by", "written by", "Written by", "Dear", "Kind regards,", "Best regards,", "Sincerely,", "Yours sincerely,", "mein Name ist", "Mein Name ist", "ich heiße", "Ich heiße", "Liebe", "Lieber", "je m'appelle", "Je m'appelle", "me llamo", "Me llamo", "mi nombre es", "Mi nombre es", "Меня зовут", "меня зовут", "Уважаемый", "Уважаемая", "С уважением,"]
_GAP = "[ \u00a0]+"
_PART = r"(?:[A-ZÀ-ÖØ-ÞА-ЯЁ]['’])?[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+(?:[A-Z][a-z]+)?"
_WORD = rf"{_PART}(?:-{_PART})?"
_LAST = rf"(?:(?:de|del|la|da|van|von|der|den|di|du|bin|al){_GAP}){{0,3}}(?P<%s>{_WORD})"
_any = lambda words: "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
NAME = re.compile(
    rf"\b(?P<title>{_any(TITLES)})\.?{_GAP}(?P<a>{_WORD})(?:{_GAP}{_LAST % 'b'})?"
    rf"|\b(?P<given>{_any(_KNOWN)}){_GAP}{_LAST % 'last'}"
    rf"|\b(?P<cue>{_any(CUES)})\s{{1,3}}(?P<first>{_WORD})(?:{_GAP}(?:[A-ZА-ЯЁ]\.{_GAP})?{_LAST % 'then'})?"
    rf"|(?<![^\W\d_])(?P<sender>{_WORD}){_GAP}(?:[A-ZА-ЯЁ]\.{_GAP})?{_LAST % 'of'}{_GAP}?(?=[<(\[][^\s<>()\[\]]+@)"
)


def luhn(digits: str) -> int:
    """The sum that is a multiple of ten in a valid card number."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value) of the entities of a text, in order, without overlap."""
    out = []
    for m in CONTACT.finditer(text):
        kind, value = m.lastgroup, m[0]
        if kind == "email":
            value = value.lower()
        elif kind in ("phone", "card", "ssn"):
            value = re.sub(r"\D", "", value)
            if kind == "phone":
                if len(value) < 9:
                    continue
                value = value[-10:]
        elif kind == "iban":
            value = value.replace(" ", "")
        out.append((m.start(), m.end(), kind, value))
    families = set()
    for m in NAME.finditer(text):
        gender = TITLES.get(m["title"], "n") if m["title"] else "n"
        first, last = next((f, g) for f, g in (("a", "b"), ("given", "last"), ("first", "then"), ("sender", "of")) if m[f])
        if first == "first" and m[first] in TITLES:
            continue
        alone = "family" if m["title"] and not m[last] else f"given_{gender}"
        out.append((*m.span(first), _KNOWN.get(m[first], alone), m[first].casefold()))
        if m[last]:
            out.append((*m.span(last), "family", m[last].casefold()))
            families.add(m[last])
        elif out[-1][2] == "family":
            families.add(m[first])
    if families:
        for m in re.finditer(rf"\b(?:{_any(families)})\b", text):
            out.append((*m.span(), "family", m[0].casefold()))
    out.sort(key=lambda x: (x[0], -x[1]))
    kept, at = [], 0
    for x in out:
        if x[0] >= at:
            kept.append(x)
            at = x[1]
    return kept


class Keyed:
    """Numbers that follow from a key and what they are for."""

    def __init__(self, key: bytes, *what: object):
        self.key = hashlib.blake2b(key, digest_size=32, key=b"surrogates", person=b"k").digest()
        self.what = "\x1f".join(map(str, what)).encode("utf-8", "surrogatepass")

    def number(self, *more: int) -> int:
        return int.from_bytes(hmac.digest(self.key, self.what + b"\x1f" + ",".join(map(str, more)).encode(), "sha256")[:16], "big")

    def permuted(self, x: int, n: int, rounds: int = 8) -> int:
        """A permutation of 0 to n - 1: a Feistel network over the next even number of bits, walked until it is below n again."""
        half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            left, right = x >> half, x & mask
            for k in range(rounds):
                left, right = right, left ^ self.number(k, half, right) & mask
            x = left << half | right
            if x < n:
                return x


def _sets(text: str) -> list[str]:
    """For each character those that may stand in its place: its class, or itself."""
    return ["0123456789" if c in "0123456789" else "abcdefghijklmnopqrstuvwxyz" if "a" <= c <= "z" else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if "A" <= c <= "Z" else c for c in text]


def permuted_text(keyed: Keyed, text: str, sets: list[str], more: str = "", extra: int = 0) -> str:
    """Another text, character by character out of the sets; one to one over all texts of these sets.

    `extra` characters out of `more` follow, which makes the space as much larger.
    """
    sets = [*sets, *[more] * extra]
    x, n = 0, 1
    for c, s in zip(text + more[:1] * extra, sets):
        x, n = x * len(s) + s.index(c), n * len(s)
    x, out = keyed.permuted(x, n), []
    for s in reversed(sets):
        x, k = divmod(x, len(s))
        out.append(s[k])
    return "".join(reversed(out))


# What made-up names are put together from: beginnings and vowels of syllables, and endings by gender or for families.
LATIN = {"begin": "b d f g h j k l m n p r s t v w br dr fr gr kr tr st sh".split(), "vowel": "a e i o u".split(), "given_f": "na la ra lia nia ssa tta dra line belle wyn della".split(), "given_m": "n r s rd lf k nt mir ld ric mond ton".split(), "given_n": "n l ne ll s y rin len sh m ren ley".split(), "family": "nson rman lberg ston field well mann ridge rd ley sen rick".split()}
CYRILLIC = {"begin": "б в г д ж з к л м н п р с т ф х бр гр др кр тр ст вл зл".split(), "vowel": "а е и о у".split(), "given_f": "на ла ра лия ния ва та да са ня ся ка".split(), "given_m": "н р с й м т слав мир лай дар рат вей".split(), "given_n": "н ня ша ля с р м й та ка ло ко".split(), "family": "лов нев рин сов тин ков хин лин ров мин вин нов".split()}


def made_name(keyed: Keyed, kind: str, value: str, attempt: int) -> str:
    """A made-up name of the value's script, kind and about its length; each attempt adds a syllable, so there are always more."""
    if "-" in value:
        return "-".join(made_name(keyed, kind, x, attempt) for x in value.split("-"))
    parts = CYRILLIC if re.search("[а-яё]", value) else LATIN
    x = keyed.number(attempt, *value.encode("utf-8", "surrogatepass"))
    out = []
    for _ in range(1 + (len(value) > 4) + (len(value) > 8) + attempt):
        x, k = divmod(x, len(parts["begin"]))
        x, v = divmod(x, len(parts["vowel"]))
        out.append(parts["begin"][k] + parts["vowel"][v])
    ending = parts[kind][x % len(parts[kind])]
    female = kind == "family" and parts is CYRILLIC and re.search("(?:ов|ев|ёв|ин|ын)а$", value)
    return "".join(out) + ending + ("а" if female else "")


def iban_rest(iban: str) -> int:
    """1 for an IBAN with right check digits."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The canonical surrogate of a canonical value: same kind, format, script and, for names, gender.

    Values of one format have different surrogates: it is a keyed permutation of the format. From the third attempt on the
    format grows by a character each time. Cards and IBANs with right check digits keep them right.
    """
    keyed, extra, digits = Keyed(key, kind, attempt), max(0, attempt - 1), "0123456789"
    if kind.startswith("given") or kind == "family":
        return made_name(Keyed(key, kind), kind, value, attempt)
    if kind == "email":
        local, _, domain = value.partition("@")
        labels, fixed = domain.split("."), Keyed(key, "domain")
        host = ".".join([permuted_text(fixed, x, _sets(x)) for x in labels[:-1]] + labels[-1:])
        return permuted_text(keyed, local, _sets(local), "abcdefghijklmnopqrstuvwxyz", extra) + "@" + host
    if kind == "ip":
        x = int.from_bytes(bytes(map(int, value.split("."))), "big")
        return ".".join(map(str, keyed.permuted(x << 8 * extra, 1 << 8 * (4 + extra)).to_bytes(4 + extra, "big")))
    if kind == "iban":
        made = permuted_text(keyed, value[4:], _sets(value[4:]), digits, extra)
        check = value[2:4] if iban_rest(value) != 1 else f"{98 - iban_rest(value[:2] + '00' + made):02d}"
        return value[:2] + check + made
    sets = [digits] * len(value)
    if kind == "phone":
        sets[0] = value[0] if value[0] in "01" else "23456789"
    if kind != "card":
        return permuted_text(keyed, value, sets, digits, extra)
    body = value[0] + permuted_text(keyed, value[1:-1], sets[1:-1], digits, extra)
    return next(body + d for d in digits if luhn(body + d) == 0) if luhn(value) == 0 else body + value[-1]


def rendered(mention: str, kind: str, value: str, made: str) -> str:
    """The surrogate in the format of the mention: its separators, its capitals, its country code."""
    if kind in ("phone", "card", "ssn", "iban"):
        solid = [k for k, c in enumerate(mention) if c.isalnum()][-len(value) :]
        out = list(mention)
        for k, c in zip(solid, made):
            out[k] = c
        return "".join(out) + made[len(solid) :]
    if kind.startswith("given") or kind == "family":
        made = "-".join(x.capitalize() for x in made.split("-"))
        return made.upper() if mention.isupper() else made
    if kind == "email" and mention.isupper():
        return made.upper()
    return made


def replaced(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, list[str]]:
    out, kinds, at = [], [], 0
    for s, e, kind, value in mentions(text):
        out += [text[at:s], rendered(text[s:e], kind, value, surrogate(key, kind, value, attempts.get((kind, value), 0)))]
        kinds.append(kind)
        at = e
    return "".join([*out, text[at:]]), kinds


#: Distinct entities in one partition of a round.
ROUND_ROWS = 10_000

#: What every entity but those of @ or four ASCII digits holds: a title, cue or given name, other digits, an IBAN's first six.
HINT = "|".join([*sorted({*TITLES, *CUES, *_KNOWN}), r"[^\P{Nd}0-9]", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"])


def worth_reading(array: pa.Array) -> np.ndarray:
    """Texts that may hold an entity, no fewer than those with mentions: with an @, four digits or HINT."""
    data, at = as_bytes(array)
    sums = lambda mask: np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    digits, signs = sums((data >= 48) & (data <= 57)), sums(data == 64)
    out = (digits[at[1:]] - digits[at[:-1]] >= 4) | (signs[at[1:]] > signs[at[:-1]])
    rest = np.flatnonzero(~out)
    out[rest] = pc.match_substring_regex(array.take(pa.array(rest)), HINT).to_numpy(zero_copy_only=False).astype(bool)
    return out


def entity_parts(df: DataFrame) -> DataFrame:
    """(id, kind, value) of the entities of each text, each once."""
    kind = df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            row, kinds, values = [], [], []
            for k in np.flatnonzero(worth_reading(block.column(1))).tolist():
                for what, value in {(m[2], m[3]) for m in mentions(block.column(1)[k].as_py())}:
                    row.append(k)
                    kinds.append(what)
                    values.append(value)
            if row:
                yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(row)), pa.array(kinds), pa.array(values)], names=["id", "kind", "value"])

    return df.mapInArrow(run, f"id {kind}, kind string, value string")


def attempts_of(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt) for distinct entities, such that all surrogates of a kind are distinct and none is an original.

    In each round the entity of the lowest attempt, then value, keeps a surrogate that several want; the others,
    and those whose surrogate is somebody's value, try again. It ends when nobody has to; that always comes, as formats
    and names grow with the attempts. Surrogates of one format never meet, so few have to try again.
    """

    def made(kinds: pd.Series, values: pd.Series, tries: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, v, a) for k, v, a in zip(kinds, values, tries)], dtype=object)

    make = F.pandas_udf(made, "string")
    rows = entities.count()
    few = lambda df: checkpointed(gathered(df, rows, ROUND_ROWS))
    class_of = F.when(F.col("kind").startswith("given"), F.lit("given")).otherwise(F.col("kind")).alias("class")
    wanted = lambda df: few(df.select("kind", "value", "attempt", class_of, make("kind", "value", "attempt").alias("made")))
    state = wanted(entities.select("kind", "value").distinct().withColumn("attempt", F.lit(0)))
    rows = state.count()
    originals = few(state.select("class", F.col("value").alias("made")).distinct())
    while True:
        best = state.groupBy("class", "made").agg(F.min(F.struct("attempt", "value", "kind")).alias("best"), F.count("*").alias("n"))
        shown = originals.join(state.select("class", "made").distinct(), ["class", "made"]).withColumn("real", F.lit(True))
        trouble = best.join(shown, ["class", "made"], "left").where("n > 1 or real")
        judged = state.join(trouble, ["class", "made"], "left")
        again = F.coalesce(F.col("real"), F.lit(False)) | (F.col("n").isNotNull() & (F.struct("attempt", "value", "kind") != F.col("best")))
        judged = few(judged.withColumn("again", again).select("kind", "value", "attempt", "class", "made", "again"))
        if judged.where("again").isEmpty():
            return judged.select("kind", "value", "attempt")
        state = few(judged.where("not again").drop("again").union(wanted(judged.where("again").select("kind", "value", (F.col("attempt") + 1).alias("attempt")))))


def pseudonymise(df: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Replace e-mail addresses, phone and card numbers, IP addresses, IBANs, SSNs and names in whole texts.

    A surrogate follows from the secret key, the kind and the value alone, so a value has the same one everywhere (phones
    by their last ten digits in any format; names part by part). Over the table's distinct values surrogates of
    a kind are made distinct, and no surrogate is a value of the table. Only values that had to try again, few
    as the formats are permuted, are joined to their texts. Cards keep their first digit, cards and IBANs valid
    check digits, phones the country code and separators, names script, gender and about their length.

    Names are found by what stands around them (titles, phrases such as "my name is", an address in brackets behind
    them) or by a common given name in front; a family name so found is replaced in all of its text.

    Null text is empty and has no entity; texts of any length are read whole; repeated rows are replaced alike; a null id is
    an id; an empty table gives no rows; other columns are ignored, whatever their names. Returns id, text, n_entities and a
    count n_<kind> of each kind.
    """
    if not key:
        raise ValueError("a secret key is required")
    spark = prepare(df.sparkSession)
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_kind = own.schema["id"].dataType.simpleString()
    found = checkpointed(gathered(entity_parts(own), df.count()))
    tries = attempts_of(found, key).where("attempt > 0")
    again = checkpointed(gathered(tries, tries.count()))
    if again.isEmpty():
        joined = own.withColumn("again", F.lit(None).cast("array<struct<kind: string, value: string, attempt: int>>"))
    else:
        listed = joined_hot(found, again, ["kind", "value"]).groupBy(F.col("id").alias("of")).agg(F.collect_set(F.struct("kind", "value", "attempt")).alias("again"))
        joined = own.join(checkpointed(gathered(listed, found.count())), F.col("id").eqNullSafe(F.col("of")), "left").select("id", "text", "again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            read, texts, counts = worth_reading(block.column(1)), block.column(1).to_pylist(), []
            for k, more in enumerate(block.column(2).to_pylist()):
                kinds: list[str] = []
                if read[k]:
                    texts[k], kinds = replaced(texts[k], key, {(x["kind"], x["value"]): x["attempt"] for x in more or ()})
                counts.append([kinds.count(x) for x in KINDS])
            table = np.array(counts, np.int64)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(texts, pa.string()), pa.array(table.sum(1)), *(pa.array(np.ascontiguousarray(table[:, i])) for i in range(len(KINDS)))], names=["id", "text", "n_entities", *(f"n_{x}" for x in KINDS)])

    out = joined.mapInArrow(run, f"id {id_kind}, text string, n_entities long, " + ", ".join(f"n_{x} long" for x in KINDS))
    return out.withColumnRenamed("id", id_col)
