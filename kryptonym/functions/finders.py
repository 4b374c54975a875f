"""What takes more than a pattern to find: companies, names, addresses, domains, numbers at any distance behind a label.

A finder gives the (start, stop) of values in a text, ascending and apart. All run in linear time, whatever the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

Spans = Iterator[tuple[int, int]]

# Legal forms, endings, abbreviations, labels and zones that decide what is found.
LEGAL_FORMS = "ООО ОАО ЗАО АО ПАО НАО ГУП МУП ФГУП НКО АНО КФХ ПК ТСЖ НП".split()
QUOTED_FORMS = [*LEGAL_FORMS, "Банк", "Фонд"]
PATRONYMIC_ENDS = "вич вна ич на".split()
CASE_ENDS = "а у ем е ой ы ю".split()
ADDRESS_DOTS = "г ул пр пл ш наб пер бульв д дом стр корп к кв офис пом эт обл пос п с дер мкр им".split()
ADDRESS_ENDS = "СНИЛС паспорт серия телефон".split()
POSTAL_ENDS = ["ИНН", "ОГРН", "СНИЛС", "паспорт", "телефон", "расчётный", "р/с", "БИК"]
POSTAL_LABELS = ["юридический", "почтовый", "фактический", "адрес проживания", "адрес"]
STREETS = "пр-т просп бульв б-р мкр наб пер ул пр ш пл".split()
HOUSE_PARTS = "д дом стр корп к кв офис оф пом эт".split()
ZONES = "ru рф com net org su io pro biz info me by kz".split()

CYRILLIC_CAPITALS = frozenset("АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ")
CYRILLIC_SMALL = frozenset("абвгдеёжзийклмнопрстуфхцчшщъыьэюя")
LATIN_CAPITALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
CYRILLIC = CYRILLIC_CAPITALS | CYRILLIC_SMALL
LETTERS = CYRILLIC | LATIN_CAPITALS | frozenset("abcdefghijklmnopqrstuvwxyz")
OF_DOMAIN = LETTERS | frozenset("0123456789")

_word = re.compile("[А-Яа-яЁё]+")
_initials = re.compile(r"[А-ЯЁ]\.[А-ЯЁ]\.")


def at(text: str, i: int) -> str:
    """The character at i, none beyond the ends."""
    return text[i] if 0 <= i < len(text) else ""


def skip(text: str, i: int) -> int:
    """Behind the white space at i."""
    while i < len(text) and text[i].isspace():
        i += 1
    return i


def is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def capitalised(word: str, most: int = 10**9) -> bool:
    """A capital and one to `most` small Cyrillic letters."""
    return 1 < len(word) <= most + 1 and word[0] in CYRILLIC_CAPITALS and CYRILLIC_SMALL.issuperset(word[1:])


# Names.


def full_name(text: str) -> Spans:
    """Family name, given name and patronymic, in any case."""
    endings = tuple(p + c for p in PATRONYMIC_ENDS for c in ("", *CASE_ENDS))
    words = list(_word.finditer(text))
    k = 0
    while k + 2 < len(words):
        a, b, c = words[k : k + 3]
        together = text[a.end() : b.start()].isspace() and text[b.end() : c.start()].isspace()
        if together and capitalised(a[0], 20) and capitalised(b[0], 20) and capitalised(c[0]) and c[0][1:].endswith(endings) and not is_word(at(text, c.end())):
            yield a.start(), c.end()
            k += 3
        else:
            k += 1


def name_initials(text: str) -> Spans:
    """A family name before two initials."""
    done = 0
    for m in _word.finditer(text):
        if m.start() < done or not capitalised(m[0], 20):
            continue
        i = skip(text, m.end())
        if i > m.end() and (two := _initials.match(text, i)):
            done = two.end()
            yield m.start(), done


def initials_name(text: str) -> Spans:
    """Two initials before a family name."""
    i = 0
    while m := _initials.search(text, i):
        name = _word.match(text, skip(text, m.end()))
        if name and capitalised(name[0], 20):
            yield m.start(), name.end()
            i = name.end()
        else:
            i = m.start() + 1


NAMES = (full_name, name_initials, initials_name)


# Companies.


def _behind(forms: list[str]) -> re.Pattern:
    return re.compile("(?:" + "|".join(forms) + r")\s+")


_quoted_form, _form, _trader = _behind([*LEGAL_FORMS, "Банк", "Фонд"]), _behind(LEGAL_FORMS), _behind(["ИП"])


def _values(text: str, form: re.Pattern, end_of) -> Spans:
    """From each form to where `end_of`(text, place behind it) says, if it says so."""
    i = 0
    while m := form.search(text, i):
        stop = end_of(text, m.end())
        if stop:
            yield m.start(), stop
        i = stop or m.start() + 1


def nested_quotes(text: str) -> Spans:
    """A form and two opening quotes of one kind with capitals between them."""

    def end_of(t: str, i: int) -> int | None:
        if at(t, i) != '"':
            return None
        k = i + 1
        while k < len(t) and k - i <= 8 and (t[k] in CYRILLIC_CAPITALS or t[k] in LATIN_CAPITALS):
            k += 1
        inner = skip(t, k)
        if k == i + 1 or inner == k or at(t, inner) != '"':
            return None
        close = t.find('"', inner + 1)
        return close + 1 if close > inner + 1 and "\n" not in t[inner:close] else None

    return _values(text, _quoted_form, end_of)


def quoted_company(text: str) -> Spans:
    """A form and a name in quotes."""

    def end_of(t: str, i: int) -> int | None:
        if at(t, i) not in ("«", '"', "„") or i >= len(t):
            return None
        k = i + 1
        while k < len(t) and (is_word(t[k]) or t[k].isspace() or t[k] in ".-"):
            k += 1
        return k + 1 if k > i + 1 and at(t, k) in ("»", '"') and k < len(t) else None

    return _values(text, _quoted_form, end_of)


def bare_company(text: str) -> Spans:
    """A form and a name that begins with a capital: as much of the next thirty letters, spaces and dashes as ends before white space or a sign."""

    def end_of(t: str, i: int) -> int | None:
        if at(t, i) not in CYRILLIC_CAPITALS or i >= len(t):
            return None
        k = i + 1
        while k < len(t) and k - i <= 30 and (t[k] in CYRILLIC or t[k].isspace() or t[k] == "-"):
            k += 1
        while k - i > 2 and not (k == len(t) or t[k].isspace() or t[k] in ",.;)"):
            k -= 1
        return k if k - i > 2 else None

    return _values(text, _form, end_of)


def trader_initials(text: str) -> Spans:
    """A sole trader's family name with initials."""

    def end_of(t: str, i: int) -> int | None:
        name = _word.match(t, i)
        two = _initials.match(t, skip(t, name.end())) if name and capitalised(name[0]) and at(t, name.end()).isspace() else None
        return two.end() if two else None

    return _values(text, _trader, end_of)


def trader_name(text: str) -> Spans:
    """A sole trader's three names; what follows the small letters of the third is left."""

    def end_of(t: str, i: int) -> int | None:
        for turn in range(3):
            name = _word.match(t, i)
            if not name:
                return None
            k = i + 1
            while k < name.end() and t[k] in CYRILLIC_SMALL:
                k += 1
            if t[i] not in CYRILLIC_CAPITALS or k == i + 1 or (turn < 2 and not at(t, k).isspace()):
                return None
            i = skip(t, k)
        return k

    return _values(text, _trader, end_of)


COMPANIES = (nested_quotes, quoted_company, bare_company, trader_initials, trader_name)


# Addresses.


def sentence_ends(text: str, i: int) -> bool:
    """Whether the dot at i ends a sentence: a capital, a placeholder or nothing comes next, and no abbreviation or initial stands before it."""
    after = skip(text, i + 1)
    following = at(text, after)
    if following and (after == i + 1 or not (following == "[" or following in CYRILLIC_CAPITALS or following in LATIN_CAPITALS)):
        return False
    k = i
    while k and is_word(text[k - 1]):
        k -= 1
    word = text[k:i]
    return word not in ADDRESS_DOTS and not (len(word) == 1 and (word in CYRILLIC_CAPITALS or word in LATIN_CAPITALS))


def _stops(labels: list[str], aside: bool) -> re.Pattern:
    """Where an address may end: before a comma and a label, before a remark, at the text's end, at a line's end, at a dot."""
    remark = r"|(?<!\s)\s*\(далее" if aside else ""
    return re.compile(r",\s*(?:" + "|".join(labels) + ")" + remark + r"|(?<!\s)\s*\Z|\n|\.")


class _Ahead:
    """The next match of a pattern in a text, looked for once for all places up to it."""

    def __init__(self, pattern: re.Pattern, text: str):
        self.pattern, self.text, self.found = pattern, text, None
        self.since, self.until = 0, -1

    def search(self, i: int) -> re.Match | None:
        if not self.since <= i <= self.until:
            self.since, self.found = i, self.pattern.search(self.text, i)
            self.until = self.found.start() if self.found else len(self.text)
        return self.found


def _end_of_address(text: str, start: int, least: int, most: int, stops: _Ahead) -> int | None:
    """The first end at least `least` and at most `most` behind the start, on its line."""
    i = start + least
    if "\n" in text[start:i] or i > len(text):
        return None
    if skip(text, i) == len(text):
        return i
    while m := stops.search(i):
        if m.start() > start + most or m[0] == "\n" and m.end() < len(text):
            return None
        if m[0] != "." or sentence_ends(text, m.start()):
            return m.start()
        i = m.start() + 1
    return None


def _labelled(text: str, label: re.Pattern, stops: re.Pattern, value_of=None) -> Spans:
    i, ahead = 0, [_Ahead(stops, text), _Ahead(stops, text)]
    while m := label.search(text, i):
        found = value_of(text, m.end(), ahead) if value_of else _end_of_address(text, m.end(), 1, len(text), ahead[0]) if m.end() < len(text) else None
        if found:
            yield m.end(), found
        i = found or m.start() + 1


_registered = re.compile(r"зарегистрирован[а-яё]*\s+по\s+адресу\s*:\s*")
_registration = re.compile(r"адрес\s+регистрации\s*:\s*")
_postal = re.compile("(?:" + "|".join(POSTAL_LABELS) + r")\s*(?:адрес)?\s*:\s*")
_town = re.compile(r"г(?:ород|\.)?\s+")
_person_stops, _company_stops = _stops(ADDRESS_ENDS, True), _stops(POSTAL_ENDS, False)


def registered_at(text: str) -> Spans:
    return _labelled(text, _registered, _person_stops)


def registration_address(text: str) -> Spans:
    return _labelled(text, _registration, _person_stops)


def postal_address(text: str) -> Spans:
    """A letter, perhaps behind a town's mark, and 10 to 200 characters."""

    def value_of(t: str, i: int, aheads: list[_Ahead]) -> int | None:
        town = _town.match(t, i)
        for first, ahead in zip([town.end() if town else i, i], aheads):
            if at(t, first) in LETTERS and first < len(t) and (end := _end_of_address(t, first, 11, 201, ahead)):
                return end
        return None

    return _labelled(text, _postal, _company_stops, value_of)


def _piece(text: str, i: int) -> int:
    """To the comma, the line's end or the sentence's."""
    while i < len(text) and text[i] not in ",\n" and not (text[i] == "." and sentence_ends(text, i)):
        i += 1
    return i


def _behind_comma(text: str, i: int) -> int | None:
    i = skip(text, i)
    return skip(text, i + 1) if at(text, i) == "," else None


def _city(text: str, i: int) -> Iterator[int]:
    """Ends of a town's name at i: of two words, then of one."""
    first = _word.match(text, i)
    if not first or not capitalised(first[0]):
        return
    end = first.end()
    while at(text, end) == "-" and (more := _word.match(text, end + 1)):
        end = more.end()
    second = _word.match(text, skip(text, end))
    if second and second.start() > end and capitalised(second[0]):
        yield second.end()
    yield end


def _street(text: str, i: int) -> int | None:
    """The end of a street: its kind, white space, a letter and something more."""
    for kind in STREETS:
        if text.startswith(kind, i):
            k = i + len(kind)
            for start in ([k + 1] if at(text, k) == "." else []) + [k]:
                name = skip(text, start)
                if name > start and at(text, name) in CYRILLIC and name < len(text) and (end := _piece(text, name + 1)) > name + 1:
                    return end
    return None


def _house(text: str, i: int) -> int | None:
    """The end of a part of a house's number: its kind and anything, or a bare number with a letter."""
    for kind in HOUSE_PARTS:
        if text.startswith(kind, i):
            k = i + len(kind)
            if at(text, k) == "." and not sentence_ends(text, k):
                k += 1
            end = _piece(text, k)
            if end > k or k > i + len(kind):
                return end
    k = i
    while at(text, k).isdecimal():
        k += 1
    return None if k == i else k + (k < len(text) and text[k] in CYRILLIC)


def bare_address(text: str) -> Spans:
    """Town, street, house and its parts, between commas."""
    i = 0
    while m := _town.search(text, i):
        i = m.start() + 1
        if is_word(at(text, m.start() - 1)):
            continue
        for city in _city(text, m.end()):
            street = _behind_comma(text, city)
            end = _street(text, street) if street else None
            last = None
            while end and (part := _behind_comma(text, end)) and (end := _house(text, part)):
                last = end
            if last:
                yield m.start(), last
                i = last
                break


ADDRESSES = (registered_at, registration_address, postal_address, bare_address)


# Domains.

_domain = re.compile("[A-Za-zА-Яа-яЁё0-9.-]+")


def website(text: str) -> Spans:
    """A domain by itself: labels with dots between them, the last of them a known zone, and no part of an address or a path."""
    for m in _domain.finditer(text):
        before = at(text, m.start() - 1)
        if before and (is_word(before) or before in "@/"):
            continue
        labels = m[0].split(".")
        good = 0
        while good < len(labels) and labels[good] and labels[good][0] != "-":
            good += 1
        for k in reversed(range(1, good)):
            if labels[k].lower() not in ZONES:
                continue
            end = m.start() + len(".".join(labels[: k + 1]))
            after = at(text, end)
            if after and (is_word(after) or after in "/?#-") or after == "." and at(text, end + 1) in OF_DOMAIN and end + 1 < len(text):
                continue
            yield m.start(), end
            break


# Numbers at any distance behind a label.


def _labelled_number(text: str, label: str, digits: int, between: str, exact: bool) -> Spans:
    """The first number of at least so many digits behind a label, with nothing but word characters, white space and `between` in the gap.

    Where the gap ends at : / or №, the number has to follow it. exact: no digit may follow, so the last digits of a longer
    number are taken. What comes next is looked for once for all labels before it.
    """
    following = re.compile(rf"\d{{{digits},}}|[^\s\w{re.escape(between)}]")
    i, event = 0, None
    while (start := text.find(label, i)) >= 0:
        gap = start + len(label)
        if event is None or event.start() < gap:
            event = following.search(text, gap)
        if event is None:
            return
        i = start + 1
        number = event if event[0][0].isdecimal() else None
        if number is None and event[0] in ":/№":
            first = skip(text, event.end())
            run = re.compile(r"\d+").match(text, first)
            if run and (len(run[0]) == digits or len(run[0]) > digits and not exact):
                yield first, first + digits
                i = first + digits
        elif number:
            first = number.end() - digits if exact else number.start()
            yield first, first + digits
            i = first + digits


def tax_number_of(digits: int):
    def tax_number(text: str) -> Spans:
        return _labelled_number(text, "ИНН", digits, "()", True)

    return tax_number


def bank_code(text: str) -> Spans:
    return _labelled_number(text, "БИК", 9, "", False)
