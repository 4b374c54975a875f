"""One text after another: rules, dictionary, layers and restoring, without Spark."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kryptonym.functions.dictionary import parse
from kryptonym.functions.layers import Lexicon, Parse, WordTagger, is_known_personal, is_personal, is_stop_form, is_stop_word, is_verb, repaired, tagged, view
from kryptonym.functions.rules import BY_ID, DEFAULT, RULES, chosen
from kryptonym.functions.text import preprocess
from kryptonym.operators.masker import Config, Masker, ambiguous, restore


def masked(text, **config):
    m = Masker(Config(**config))
    return m.mask(text), [(k["placeholder"], k["original"]) for k in m.keys]


EXAMPLES = [
    ("company", 'ООО "СЗ "Долина 1" тут', 'ООО "СЗ "Долина 1"'),
    ("company", "Фонд «Северный ветер» дал", "Фонд «Северный ветер»"),
    ("company", "ООО Вектор, далее", "ООО Вектор"),
    ("company", "ИП Петрова Е.С. платит", "ИП Петрова Е.С."),
    ("company", "ИП Петрова Елена Сергеевна", "ИП Петрова Елена Сергеевна"),
    ("project", "ОБЪЕКТ «Луна 2» сдан", "ОБЪЕКТ «Луна 2»"),
    ("egrn", "77:18:0170408:1873-77/060/2025-1", "77:18:0170408:1873-77/060/2025-1"),
    ("kadastr", "участок 77:18:0170408:1873.", "77:18:0170408:1873"),
    ("fio", "у Кузнецова Андрея Викторовича", "Кузнецова Андрея Викторовича"),
    ("fio", "Орлов А.Б. и", "Орлов А.Б."),
    ("fio", "подпись А.Б. Орлов", "А.Б. Орлов"),
    ("passport_issued", "выдан: ГУ МВД РОССИИ ПО Г. МОСКВЕ, дата", "ГУ МВД РОССИИ ПО Г. МОСКВЕ"),
    ("passport", "серия 4524 № 795984", "4524 № 795984"),
    ("snils", "СНИЛС № 112-233-445 95", "112-233-445 95"),
    ("podrazd", "код подразделения: 770-001", "770-001"),
    ("date_birth", "01.02.1980 г. р.", "01.02.1980"),
    ("date_issue", "Дата выдачи 01.02.2010", "01.02.2010"),
    ("place_birth", "место рождения: гор. Тула, паспорт", "гор. Тула"),
    ("address", "зарегистрированной по адресу: г. Тула, ул. Мира, д. 7. Контакт", "г. Тула, ул. Мира, д. 7"),
    ("address", "почтовый адрес: город Пермь, площадь Мира, ИНН", "город Пермь, площадь Мира"),
    ("address", "в г. Казань, пр-т Победы, 14 утром", "г. Казань, пр-т Победы, 14"),
    ("account", "к/с № 30101810400000000225", "30101810400000000225"),
    ("ogrn", "ОГРН 1157799001122", "1157799001122"),
    ("inn_fl", "ИНН поручителя: 503300112233", "503300112233"),
    ("inn_ul", "ИНН: 7799001122", "7799001122"),
    ("kpp", "КПП: 779901001", "779901001"),
    ("bik", "БИК банка 044525999", "044525999"),
    ("swift", "swift: sabrrumm", "sabrrumm"),
    ("phone", "+7 (499) 555-12-34", "+7 (499) 555-12-34"),
    ("email", "a.b@c.ru", "a.b@c.ru"),
    ("website", "сайт firma.ru.", "firma.ru"),
    ("amount", "12 500 000 ₽ всего", "12 500 000 ₽"),
    ("amount", "5 рублей", "5 рублей"),
    ("date", "3 марта 2024", "3 марта 2024"),
]


@pytest.mark.parametrize("rule,text,value", EXAMPLES)
def test_rule_finds(rule, text, value):
    out, keys = masked(text, enabled=frozenset({rule}))
    assert keys == [(f"[{BY_ID[rule].label}_1]", value)]
    assert out == text.replace(value, keys[0][0])


QUIET = [
    ("company", "компания ромашка"),
    ("kadastr", "77:18:01704:1873"),
    ("fio", "Отчёт за год"),
    ("passport", "Серия 4524 № 795984"),
    ("kpp", "779901001"),
    ("bik", "054525999"),
    ("inn_ul", "77990011223"),
    ("website", "ссылка firma.ru/path и https://firma.ru"),
    ("website", "почта a@firma.ru"),
    ("website", "г.Москва и т.д."),
    ("date_birth", "01.02.1980 года"),
    ("address", "встреча в г. Казань утром"),
]


@pytest.mark.parametrize("rule,text", QUIET)
def test_rule_leaves(rule, text):
    assert masked(text, enabled=frozenset({rule})) == (text, [])


def test_all_rules_and_defaults():
    assert len(RULES) == 25 and sum(len(r.forms) for r in RULES) == 43 and len(DEFAULT) == 23
    assert [r.id for r in chosen(set())] == [r.id for r in RULES if r.default]
    with pytest.raises(ValueError):
        chosen({"nothing"})


def test_order_longest_numbers_first():
    out, _ = masked("40702810500000099887 1157799001122 503300112233 7799001122")
    assert out == "[СЧЁТ_1] [ОГРН_1] [ИНН_ФЛ_1] [ИНН_ЮЛ_1]"


def test_numbers_and_repeats():
    out, keys = masked("a@x.ru, b@x.ru, a@x.ru")
    assert out == "[EMAIL_1], [EMAIL_2], [EMAIL_1]" and len(keys) == 2


def test_state_lasts_over_texts_and_not_over_maskers():
    m = Masker()
    assert [m.mask("a@x.ru"), m.mask("b@x.ru a@x.ru")] == ["[EMAIL_1]", "[EMAIL_2] [EMAIL_1]"]
    assert m.counts == {"EMAIL": 2} and m.replaced == 3
    assert masked("b@x.ru")[0] == "[EMAIL_1]"


def test_space_around_a_value_stays():
    assert masked("ООО Вектор , да")[0] == "[КОМПАНИЯ_1] , да"


def test_address_may_hold_a_masked_name():
    out, keys = masked("адрес регистрации: дом Орлова А.Б. третий")
    assert out == "адрес регистрации: [АДРЕС_1]" and keys[-1] == ("[АДРЕС_1]", "дом [ФИО_1] третий")
    assert restore(out, keys[::-1]) == "адрес регистрации: дом Орлова А.Б. третий"


@pytest.mark.parametrize("text", [None, "", " ", "\n\n", "[", "]["])
def test_nothing_to_do(text):
    assert masked(text) == (text, [])


def test_preprocess():
    assert preprocess("й") == "й"
    assert preprocess("9 7 2 1 1 8 1 7 8 3") == "9721181783"
    assert preprocess("1 2 3 4 5") == "1 2 3 4 5"
    spaced = " ".join("7799001122" + "4" * 20)
    assert preprocess(spaced) == "7799001122 " + "4" * 20
    assert preprocess("1 2 3\n4 5 6") == "123\n456"


def test_dictionary():
    entries = parse(["# x", "", "Ромашка", "Ромашка Трейд ", "NordLight | проект", "аб", "Мир|", "Юг | адрес", "Югра | адрес"])
    assert [(e.value, e.label, e.type_id) for e in entries] == [("Ромашка Трейд", "КОМПАНИЯ", "company"), ("NordLight", "ПРОЕКТ", "project"), ("Ромашка", "КОМПАНИЯ", "company"), ("Югра", "АДРЕС", "адрес"), ("Мир", "КОМПАНИЯ", "company")]
    out, _ = masked("Ромашкой Трейд, ромашке, NORDLIGHT, Ромашкин2", dictionary=tuple(entries))
    assert out == "[КОМПАНИЯ_1], [КОМПАНИЯ_2], [ПРОЕКТ_1], Ромашкин2"


def test_equal_labels_of_different_types_never_collide():
    _, keys = masked("Югра; адрес регистрации: дом три", dictionary=tuple(parse(["Югра | адрес"])))
    assert [p for p, _ in keys] == ["[АДРЕС_1]", "[АДРЕС_2]"]


def lexicon():
    return (
        Lexicon()
        .add("Морозова", "морозов", "Surn", "sing")
        .add("Сокол", "сокол", "NOUN")
        .add("Сокол", "сокол", "Surn")
        .add("Роман", "роман", "Name")
        .add("Роман", "роман", "NOUN")
        .add("Смету", "смета", "NOUN", "sing")
        .add("Балансов", "баланс", "NOUN", "plur")
        .add("Балансов", "балансов", "Surn", known=False)
        .add("Рассчитайте", "рассчитать", "VERB")
        .add("Мсфо", "мсфо", "Surn", known=False)
    )


def test_predicates():
    x = lexicon()
    assert is_personal(x.parse("Морозова")) and is_personal(x.parse("Сокол"))
    assert not is_personal(x.parse("Роман")) and not is_personal([]) and not is_personal(x.parse("Смету"))
    assert is_known_personal(x.parse("Роман")) and not is_known_personal(x.parse("Мсфо"))
    assert is_stop_form(x.parse("Смету")) and not is_stop_form(x.parse("Балансов"))
    assert is_stop_word("Смету", x) and is_stop_word("ОБЩЕСТВО", None) and not is_stop_word("Смету", None) and not is_stop_word("Балансов", x)
    assert is_verb(x.parse("Рассчитайте")) and not is_verb([]) and not is_verb([Parse("а", True, frozenset({"VERB", "Name"}))])


def test_entities_number_from_the_end_and_names_follow():
    tagger = WordTagger({"Литвинов": "PER", "Ромашка": "ORG", "Созвон": "PER", "Рассчитайте": "PER", "Москва": "LOC", "КМ-2024-0055": "ORG"})
    text = "Рассчитайте: Литвинов, Ромашка, Созвон, Морозова, Москва, КМ-2024-0055"
    out, keys = masked(text, tagger=tagger, morphology=lexicon())
    assert out == "Рассчитайте: [ФИО_1], [КОМПАНИЯ_1], Созвон, [ФИО_2], Москва, КМ-2024-0055"
    assert keys == [("[КОМПАНИЯ_1]", "Ромашка"), ("[ФИО_1]", "Литвинов"), ("[ФИО_2]", "Морозова")]
    two, _ = masked("Литвинов и Орлова", tagger=WordTagger({"Литвинов": "PER", "Орлова": "PER"}))
    assert two == "[ФИО_2] и [ФИО_1]"


def test_names_need_the_tagger_and_rule_fio():
    assert masked("прислала Морозова", morphology=lexicon())[0] == "прислала Морозова"
    assert masked("прислала Морозова", morphology=lexicon(), tagger=WordTagger({}))[0] == "прислала [ФИО_1]"
    assert masked("прислала Морозова", morphology=lexicon(), tagger=WordTagger({}), enabled=frozenset({"email"}))[0] == "прислала Морозова"
    assert not tagged("abc def") and not tagged("абв")


def test_placeholders_are_left_alone():
    tagger = WordTagger({"ФИО_1": "PER", "ОРЛОВ": "PER"})
    assert masked("Орлов А.Б. тут", tagger=tagger)[0] == "[ФИО_1] тут"


@pytest.mark.parametrize("marker", ["·", "•", "* ", "— ", "- "])
def test_view_blanks_list_markers(marker):
    text = f"{marker}Литвинов Павел"
    assert view(text) == " " + text[1:] and len(view(text)) == len(text)


def test_view_repairs_lookalikes():
    assert repaired("ATOH") == "АТОН" and repaired("Power") == "Power" and repaired("a") == "a"
    assert view("ATOH в us06web.zoom.us/j/A и K9A") == "АТОН в us06web.zoom.us/j/A и K9A"


@given(st.text(alphabet="АТОНATOHaxw.-•· \n1@/[]", max_size=60))
def test_view_keeps_length(text):
    assert len(view(text)) == len(text)


def test_restore():
    assert restore("[А_1] и [А_1]", [("[А_1]", "x")]) == "x и x"
    assert restore("[А_1]", [("[А_1]", "в [Б_1]"), ("[Б_1]", "y")]) == "в y"
    assert restore("[А_1]", [("[А_1]", "[А_1]!")]) == "[А_1]" + "!" * 10
    assert ambiguous("уже [ФИО_1]") == ["[ФИО_1]"] and ambiguous(None) == []


PIECES = ["ИНН: 7799001122", "a@x.ru", "Орлов А.Б.", "+7 (499) 555-12-34", "ООО «Ромашка»", "г. Тула, ул. Мира, 7", "адрес: город Тула, дом пять", " ", ", ", ". ", "\n", "слово", "3 4 5 6 7 8 9", "выдан: ОВД района", "firma.ru"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_round_trip(text):
    m = Masker()
    out = m.mask(text)
    assert restore(out or "", [(k["placeholder"], k["original"]) for k in m.keys]) == preprocess(text)


def test_long_gaps_take_no_long_time():
    import time

    began = time.time()
    for filler in (" ", "слово ", "ИНН ", "БИК ", "г. Тула, ул. Мира, "):
        Masker().mask("ИНН" + filler * (30000 // len(filler)))
    assert time.time() - began < 30
