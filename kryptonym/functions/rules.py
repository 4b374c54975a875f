"""The ordered detection rules.

A rule has forms, tried one after the other. A form is either a pattern of three groups, (before)(value)(after), any of
which but the value may be empty, written so that Python's `re` and, under the prefix of `java`, Java's regular expressions
find the same; or a finder of `finders`, for what takes more than a pattern: names, companies, addresses, domains and
numbers that stand any distance behind their label. The value becomes a placeholder, the rest stays.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from kryptonym.functions import finders

# Labels, abbreviations and phrases that decide what is found.
PROJECT_WORDS = "проект объект программа инициатива".split()
ISSUERS = "ГУ УМВД МВД ОВД УФМС ФМС ОУФМС ТП ОТДЕЛЕНИЕ ОТДЕЛ".split()
NUMBER_SIGNS = "№ No N no Но".split()
ACCOUNT_LABELS = ["р/с", "к/с", "расч[её]тный\\s+счёт", "расч[её]тный\\s+счет", "счёт", "счет"]
CURRENCIES = ["₽", "руб(?:лей|ля|\\.)?", "\\$", "€", "USD", "EUR", "RUB"]
MONTHS = "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()

#: Masking never makes a number longer, so this hint is looked for once in each text.
LONG_NUMBER = r"\d{9}"


def either(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


_date = r"\d{2}\.\d{2}\.\d{4}"
_parcel = r"\d{2}:\d{2}:\d{6,7}:\d{1,5}"
Form = tuple[str, str, str] | Callable[[str], finders.Spans]


@dataclass(frozen=True)
class Rule:
    id: str
    label: str
    forms: tuple[Form, ...]
    default: bool = True
    any_case: bool = False
    #: Text without a match of this cheap pattern has none of the rule's.
    hint: str = ""

    def python(self) -> list[Callable[[str, Callable[[str], str]], str]]:
        """For each form, a function of a text and of what to put for a value."""
        return [_by_finder(f) if callable(f) else _by_pattern(re.compile("".join(f"({g})" for g in f), re.IGNORECASE if self.any_case else 0)) for f in self.forms]

    @property
    def native(self) -> bool:
        """Whether all forms are patterns."""
        return not any(map(callable, self.forms))

    def java(self) -> list[str]:
        if not self.native:
            raise ValueError(f"rule {self.id} has no native form")
        return [("(?Uid)" if self.any_case else "(?Ud)") + "".join(f"({g})" for g in f) for f in self.forms]


def _by_pattern(pattern: re.Pattern):
    return lambda text, put: pattern.sub(lambda m: m[1] + put(m[2]) + m[3], text)


def _by_finder(find):
    def apply(text: str, put) -> str:
        out, at = [], 0
        for start, stop in find(text):
            out += [text[at:start], put(text[start:stop])]
            at = stop
        return "".join([*out, text[at:]]) if out else text

    return apply


def _whole(*patterns: str) -> tuple[tuple[str, str, str], ...]:
    return tuple(("", p, "") for p in patterns)


# The patterns, in the order in which they run.
RULES: list[Rule] = [
    Rule("company", "КОМПАНИЯ", finders.COMPANIES, hint="[А-Я]"),
    Rule("project", "ПРОЕКТ", _whole(rf"{either(PROJECT_WORDS)}\s+[«\"„][\w\s.-]+[»\"]"), any_case=True, hint="[«\"„]"),
    Rule("egrn", "ЕГРН", _whole(rf"\b{_parcel}\s*-\s*\d{{2}}/\d{{3}}/\d{{4}}-\d+\b"), hint=":"),
    Rule("kadastr", "КАДАСТР", _whole(rf"\b{_parcel}\b"), hint=":"),
    Rule("fio", "ФИО", finders.NAMES, hint="[А-ЯЁ]"),
    Rule("passport_issued", "ВЫДАН", ((r"выдан\s*:?\s*", rf"{either(ISSUERS)}[^,;\n]{{5,120}}?", r"(?=,\s*(?:[Дд]ата|код\s+подразделения)|\s*$)"),), hint="выдан"),
    Rule("passport", "ПАСПОРТ", ((r"серия\s+", rf"\d{{4}}\s*{either(NUMBER_SIGNS)}?\s*\d{{6}}", ""),), hint="серия"),
    Rule("snils", "СНИЛС", ((r"СНИЛС\s*[№:]?\s*", r"\d{3}[-\s]?\d{3}[-\s]?\d{3}[-\s]?\d{2}", ""), (r"СНИЛС\s*[№:]?\s*", r"\d{11}", "")), hint="СНИЛС"),
    Rule("podrazd", "КОД_ПОДР", ((r"код\s+подразделения\s*[:№]?\s*", r"\d{3}[-\s]?\d{3}", ""),), hint="подразделения"),
    Rule("date_birth", "ДР", (("", _date, r"(?=\s*(?:года\s+рождения|г\.\s*р\.))"),), hint=r"\d\."),
    Rule("date_issue", "ДАТА_ВЫДАЧИ", ((r"[Дд]ата\s+выдачи\s*:?\s*", _date, ""),), hint="выдачи"),
    Rule("place_birth", "МЕСТО_РОЖДЕНИЯ", ((r"место\s+рождения\s*:\s*", r"[^,\n]{3,200}?", r"(?=,\s*(?:паспорт|серия)|\s*$)"),), hint="рождения"),
    Rule("address", "АДРЕС", finders.ADDRESSES, hint="адрес|г"),
    Rule("account", "СЧЁТ", ((rf"{either(ACCOUNT_LABELS)}\s*[№:\s]*", r"\d{20}", ""), ("", r"\b\d{20}\b", "")), hint=LONG_NUMBER),
    Rule("ogrn", "ОГРН", ((r"ОГРН[ИП]?\s*[:/№]?\s*", r"\d{13,15}", ""), ("", r"\b\d{15}\b", ""), ("", r"\b\d{13}\b", "")), hint=LONG_NUMBER),
    Rule("inn_fl", "ИНН_ФЛ", (finders.tax_number_of(12), ("", r"\b\d{12}\b", "")), hint=LONG_NUMBER),
    Rule("inn_ul", "ИНН_ЮЛ", (finders.tax_number_of(10), ("", r"\b\d{10}\b", "")), hint=LONG_NUMBER),
    Rule("kpp", "КПП", ((r"КПП\s*[:/№]?\s*", r"\d{9}", ""),), hint="КПП"),
    Rule("bik", "БИК", (finders.bank_code, ("", r"\b04\d{7}\b", "")), hint=LONG_NUMBER),
    Rule("swift", "SWIFT", ((r"(?:SWIFT|свифт)\s*[:/]?\s*", r"[A-Z]{6}[A-Z0-9]{2,5}", ""),), any_case=True, hint="[SsſСс][WwВв][IiИи]"),
    Rule("phone", "ТЕЛЕФОН", _whole(r"(?:\+7|8)[\s-]?\(?\d{3}\)?[\s-]?\d{3}[\s-]?\d{2}[\s-]?\d{2}", r"\b[78]\d{10}\b"), hint=r"[78]"),
    Rule("email", "EMAIL", _whole(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"), any_case=True, hint="@"),
    Rule("website", "САЙТ", (finders.website,), hint=r"\.[A-Za-zрРфФ]"),
    # A currency sign needs no word boundary after it, a currency word does.
    Rule("amount", "СУММА", _whole(rf"\d[\d\s]*(?:[,.]\d+)?\s*(?:{'|'.join(CURRENCIES[1:2] + CURRENCIES[4:])})\b|\d[\d\s]*(?:[,.]\d+)?\s*[₽$€]"), default=False, any_case=True, hint=r"\d"),
    Rule("date", "ДАТА", _whole(_date, rf"\d{{1,2}}\s+{either(MONTHS)}\s+\d{{4}}"), default=False, any_case=True, hint=r"\d"),
]
BY_ID = {r.id: r for r in RULES}
DEFAULT = frozenset(r.id for r in RULES if r.default)


def chosen(enabled: set[str] | frozenset[str] | None) -> list[Rule]:
    """The rules of the enabled ids in their order; none given or an empty set: those on by default."""
    use = enabled or DEFAULT
    unknown = set(use) - set(BY_ID)
    if unknown:
        raise ValueError(f"unknown rules: {', '.join(sorted(unknown))}")
    return [r for r in RULES if r.id in use]


@lru_cache(64)
def compiled(enabled: frozenset[str] | None) -> list[tuple[Rule, list[Callable], re.Pattern]]:
    """(rule, its forms as functions, hint) of the chosen rules."""
    return [(r, r.python(), re.compile(r.hint)) for r in chosen(enabled)]


def registry_rows() -> list[tuple]:
    """(rule_ord, form_ord, id, label, form, any_case, enabled) of every form: its pattern, or the name of its finder."""
    return [(i, j, r.id, r.label, f.__name__ if callable(f) else "".join(f"({g})" for g in f), r.any_case, r.default) for i, r in enumerate(RULES) for j, f in enumerate(r.forms)]
