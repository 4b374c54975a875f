"""Finders: what they find, what they leave, and that they take time in proportion."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kryptonym.functions import finders as N
from kryptonym.functions.dictionary import parse
from kryptonym.functions.rules import RULES

FOUND = [
    (N.full_name, "у Кузнецова Андрея Викторовича и Смирнова Анна Петровна", ["Кузнецова Андрея Викторовича", "Смирнова Анна Петровна"]),
    (N.full_name, "Петров Иван Сергеевич1 и Петров Иван Стол", []),
    (N.name_initials, "Орлов А.Б., Орлова\nВ.Г. и ОРЛОВ А.Б.", ["Орлов А.Б.", "Орлова\nВ.Г."]),
    (N.initials_name, "А.Б.Орлов, А.Б. Орлова и А.Б. ОРЛОВ", ["А.Б.Орлов", "А.Б. Орлова"]),
    (N.nested_quotes, 'ООО "СЗ "Санино 1" и ООО "сз "Санино"', ['ООО "СЗ "Санино 1"']),
    (N.quoted_company, "Банк «Север-Юг 2.0» и фонд «Мир»", ["Банк «Север-Юг 2.0»"]),
    (N.bare_company, "АО Вектор, ООО ромашка и ПАО Я", ["АО Вектор"]),
    (N.trader_name, "ИП Сидоров Иван Петрович пришёл", ["ИП Сидоров Иван Петрович"]),
    (N.registered_at, "зарегистрирован по адресу: г. Тула, ул. Б. Полянка, д. 7. Контакт: [ФИО_1]", ["г. Тула, ул. Б. Полянка, д. 7"]),
    (N.registered_at, "зарегистрирована по адресу: Тула, СНИЛС 1 и зарегистрирован по адресу: Орёл (далее — адрес)", ["Тула", "Орёл"]),
    (N.registration_address, "адрес регистрации: Тула\nдалее", []),
    (N.postal_address, "почтовый адрес: г. Пермь, площадь Мира, ИНН 1", ["г. Пермь, площадь Мира"]),
    (N.postal_address, "адрес: Пермь 1", []),
    (N.bare_address, "в г. Нижний Новгород, ул. Большая Покровская, 18 утром", ["г. Нижний Новгород, ул. Большая Покровская, 18"]),
    (N.bare_address, "г Москва, ул Красноказарменная, д 14А к 6, кв 200. Дальше", ["г Москва, ул Красноказарменная, д 14А к 6, кв 200"]),
    (N.bare_address, "г. Казань, встреча утром", []),
    (N.website, "www.firma.ru, a-b.рф. и firma.ru/x, a@firma.ru, firma.ru.x, г.Москва", ["www.firma.ru", "a-b.рф"]),
    (N.website, "x.com.-y и z.RU", ["x.com", "z.RU"]),
    (N.bank_code, "БИК " + "слово " * 200 + "123456789", ["123456789"]),
    (N.bank_code, "БИК: 044525999, БИК банка, 123456789", ["044525999"]),
    (N.tax_number_of(12), "ИНН (поручителя) № 503300112233 и ИНН 1234567890123", ["503300112233", "234567890123"]),
    (N.tax_number_of(10), "ИНН: 50330011223", []),
]


@pytest.mark.parametrize("find,text,values", FOUND)
def test_found(find, text, values):
    assert [text[a:b] for a, b in find(text)] == values


PIECES = ["г. ", "Тула", ", ", "ул. ", "Мира", "д. 7", "ООО ", "«", "»", '"', "ИП ", "Иван", "А.Б.", "ИНН ", "БИК", "№", "503300112233", "044525999", "firma", ".ru", "адрес: ", ". ", "\n", " ", "слово"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
def test_spans_ascend_and_stay_apart(text):
    for rule in RULES:
        for form in rule.forms:
            if callable(form):
                spans = list(form(text))
                assert all(0 <= a < b <= len(text) for a, b in spans) and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))


@pytest.mark.parametrize("filler", [" ", "слово ", "ИНН ", "БИК ", "ИНН:", "г. Тула, ул. Мира, ", "адрес: ", "ООО ", "А.Б.", "Иван ", "a.", "1", "зарегистрирован по адресу: "])
def test_time_in_proportion(filler):
    def took(n):
        text = "ИНН" + filler * (n // len(filler))
        began = time.perf_counter()
        for rule in RULES:
            for form in rule.forms:
                if callable(form):
                    list(form(text))
        return time.perf_counter() - began

    assert took(200_000) < 5


def test_dictionary_values():
    entry = parse(["Новая Заря"])[0]
    for text, found in (("Новой Зари", ["Новой Зари"]), ("новую\nзарю.", ["новую\nзарю"]), ("Новая Заряна1", []), ("обНовая Заря", []), ("Новая  Заря и НОВОЙ ЗАРЁЙ", ["Новая  Заря", "НОВОЙ ЗАРЁЙ"]), ("Новая, Заря", [])):
        assert [text[a:b] for a, b in entry.spans(text)] == found
