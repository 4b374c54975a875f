"""Sentences with identifiers made from the keys of a table, and what masking them must give.

A template's {name} stands for an SQL expression over the key k that Spark and DuckDB read alike.
"""

from __future__ import annotations

import re

PARTS = {
    "k": "cast(k as string)",
    "d5": "lpad(cast(k % 100000 as string), 5, '0')",
    "d6": "lpad(cast(k % 1000000 as string), 6, '0')",
    "d7": "lpad(cast(k % 10000000 as string), 7, '0')",
    "d9": "lpad(cast(770000000 + k as string), 9, '0')",
    "d10": "lpad(cast(5700000000 + k as string), 10, '0')",
    "d11": "lpad(cast(11223300000 + k as string), 11, '0')",
    "d12": "lpad(cast(503300000000 + k as string), 12, '0')",
    "d13": "lpad(cast(1157700000000 + k as string), 13, '0')",
    "d15": "lpad(cast(315774600000000 + k as string), 15, '0')",
    "a20": "concat('40702810', lpad(cast(k as string), 12, '0'))",
    "house": "cast(1 + k % 300 as string)",
    "ph": "concat(lpad(cast(k % 900 + 100 as string), 3, '0'), '-', lpad(cast(k % 90 + 10 as string), 2, '0'), '-', lpad(cast((k * 7) % 90 + 10 as string), 2, '0'))",
    "dd": "lpad(cast(1 + k % 28 as string), 2, '0')",
    "yyyy": "cast(1950 + k % 50 as string)",
}

#: name: (table, key, text, masked text, originals in the order of the keys)
TEMPLATES: dict[str, tuple[str, str, str, str, list[str]]] = {
    "mask_company_quoted": ("customer", "c_custkey", "Заёмщик ООО «Ромашка {k}» подписал", "Заёмщик [КОМПАНИЯ_1] подписал", ["ООО «Ромашка {k}»"]),
    "mask_company_nested": ("customer", "c_custkey", 'Сторона ООО "СЗ "Санино {k}" согласна', "Сторона [КОМПАНИЯ_1] согласна", ['ООО "СЗ "Санино {k}"']),
    "mask_company_unquoted": ("supplier", "s_suppkey", "Оплатил АО Вектор, счёт {k}", "Оплатил [КОМПАНИЯ_1], счёт {k}", ["АО Вектор"]),
    "mask_sole_trader": ("supplier", "s_suppkey", "ИП Петрова Е.С. и ИП Сидоров Иван Петрович, лот {k}", "[КОМПАНИЯ_1] и [КОМПАНИЯ_2], лот {k}", ["ИП Петрова Е.С.", "ИП Сидоров Иван Петрович"]),
    "mask_project": ("part", "p_partkey", "Сдан объект «Долина {k}» в срок", "Сдан [ПРОЕКТ_1] в срок", ["объект «Долина {k}»"]),
    "mask_registry": ("customer", "c_custkey", "Запись 77:18:{d7}:{d5}-77/060/2025-1 внесена", "Запись [ЕГРН_1] внесена", ["77:18:{d7}:{d5}-77/060/2025-1"]),
    "mask_cadastre": ("customer", "c_custkey", "Участок 77:18:{d7}:{d5} передан", "Участок [КАДАСТР_1] передан", ["77:18:{d7}:{d5}"]),
    "mask_full_name": ("customer", "c_custkey", "Директор Кузнецов Андрей Викторович, дело {k}; Смирнова А.Б. и В.Г. Орлов", "Директор [ФИО_1], дело {k}; [ФИО_2] и [ФИО_3]", ["Кузнецов Андрей Викторович", "Смирнова А.Б.", "В.Г. Орлов"]),
    "mask_issuer": ("customer", "c_custkey", "Паспорт выдан: ОВД района {k}, дата 01", "Паспорт выдан: [ВЫДАН_1], дата 01", ["ОВД района {k}"]),
    "mask_passport": ("customer", "c_custkey", "паспорт серия 4524 № {d6} у заявителя", "паспорт серия [ПАСПОРТ_1] у заявителя", ["4524 № {d6}"]),
    "mask_insurance_number": ("customer", "c_custkey", "СНИЛС: {d11} проверен", "СНИЛС: [СНИЛС_1] проверен", ["{d11}"]),
    "mask_department_code": ("customer", "c_custkey", "код подразделения {d6} указан", "код подразделения [КОД_ПОДР_1] указан", ["{d6}"]),
    "mask_birth_date": ("customer", "c_custkey", "Истец, {dd}.04.{yyyy} года рождения", "Истец, [ДР_1] года рождения", ["{dd}.04.{yyyy}"]),
    "mask_issue_date": ("customer", "c_custkey", "Дата выдачи: {dd}.09.{yyyy} в отделе", "Дата выдачи: [ДАТА_ВЫДАЧИ_1] в отделе", ["{dd}.09.{yyyy}"]),
    "mask_birth_place": ("customer", "c_custkey", "место рождения: село Ивановка {k}, паспорт получен", "место рождения: [МЕСТО_РОЖДЕНИЯ_1], паспорт получен", ["село Ивановка {k}"]),
    "mask_address_labelled": ("customer", "c_custkey", "зарегистрирован по адресу: г. Тула, ул. Мира, д. {house}. Контакт: да", "зарегистрирован по адресу: [АДРЕС_1]. Контакт: да", ["г. Тула, ул. Мира, д. {house}"]),
    "mask_address_postal": ("supplier", "s_suppkey", "Юр. адрес: 101000 Москва дом {house}, ИНН указан", "Юр. адрес: 101000 Москва дом {house}, ИНН указан", []),
    "mask_address_actual": ("supplier", "s_suppkey", "фактический адрес: город Пермь площадь {house}, телефон есть", "фактический адрес: [АДРЕС_1], телефон есть", ["город Пермь площадь {house}"]),
    "mask_address_bare": ("customer", "c_custkey", "Живёт в г. Нижний Новгород, ул. Большая Покровская, {house}", "Живёт в [АДРЕС_1]", ["г. Нижний Новгород, ул. Большая Покровская, {house}"]),
    "mask_account": ("customer", "c_custkey", "р/с {a20} открыт", "р/с [СЧЁТ_1] открыт", ["{a20}"]),
    "mask_state_number": ("supplier", "s_suppkey", "ОГРН: {d13} и ОГРНИП {d15}", "ОГРН: [ОГРН_1] и ОГРНИП [ОГРН_2]", ["{d13}", "{d15}"]),
    "mask_tax_person": ("customer", "c_custkey", "ИНН поручителя: {d12} верен", "ИНН поручителя: [ИНН_ФЛ_1] верен", ["{d12}"]),
    "mask_tax_company": ("supplier", "s_suppkey", "ИНН: {d10} / КПП: {d9}", "ИНН: [ИНН_ЮЛ_1] / КПП: [КПП_1]", ["{d10}", "{d9}"]),
    "mask_bank_code": ("customer", "c_custkey", "БИК: 04{d7} банка", "БИК: [БИК_1] банка", ["04{d7}"]),
    "mask_swift": ("supplier", "s_suppkey", "SWIFT: SABRRUMM, лот {k}", "SWIFT: [SWIFT_1], лот {k}", ["SABRRUMM"]),
    "mask_phone": ("customer", "c_custkey", "Звоните +7 (499) {ph} утром", "Звоните [ТЕЛЕФОН_1] утром", ["+7 (499) {ph}"]),
    "mask_email": ("customer", "c_custkey", "Почта c{k}@romashka.ru работает", "Почта [EMAIL_1] работает", ["c{k}@romashka.ru"]),
    "mask_website": ("supplier", "s_suppkey", "Сайт firma-{k}.ru. Ссылка firma.ru/{k} цела", "Сайт [САЙТ_1]. Ссылка firma.ru/{k} цела", ["firma-{k}.ru"]),
    "mask_repeats": ("customer", "c_custkey", "a{k}@x.ru, b@x.ru и снова a{k}@x.ru", "[EMAIL_1], [EMAIL_2] и снова [EMAIL_1]", ["a{k}@x.ru", "b@x.ru"]),
    "mask_untouched": ("part", "p_partkey", "План-факт за 2024 год, этап {k}: созвон и смета", "План-факт за 2024 год, этап {k}: созвон и смета", []),
    "mask_joined_digits": ("customer", "c_custkey", "ИНН 5 7 0 0 1 2 3 4 5 6 лот {k}", "ИНН [ИНН_ЮЛ_1] лот {k}", ["5700123456"]),
    "mask_nested_name": ("customer", "c_custkey", "адрес регистрации: дом Иванова А.Б. номер {k}", "адрес регистрации: [АДРЕС_1]", ["Иванова А.Б.", "дом [ФИО_1] номер {k}"]),
    "mask_bare_account": ("customer", "c_custkey", "перевод {a20} ушёл", "перевод [СЧЁТ_1] ушёл", ["{a20}"]),
    "mask_bare_state_number": ("supplier", "s_suppkey", "{d13} и {d15} в реестре", "[ОГРН_2] и [ОГРН_1] в реестре", ["{d15}", "{d13}"]),
    "mask_bare_tax_person": ("customer", "c_custkey", "номер {d12} верен", "номер [ИНН_ФЛ_1] верен", ["{d12}"]),
    "mask_bare_tax_company": ("customer", "c_custkey", "номер {d10} верен", "номер [ИНН_ЮЛ_1] верен", ["{d10}"]),
    "mask_bare_bank_code": ("customer", "c_custkey", "код 04{d7} банка", "код [БИК_1] банка", ["04{d7}"]),
    "mask_bare_phone": ("customer", "c_custkey", "звоните 7495{d7} утром", "звоните [ТЕЛЕФОН_1] утром", ["7495{d7}"]),
    "mask_dashed_insurance_number": ("customer", "c_custkey", "СНИЛС № 112-233-445 {dd} и лот {k}", "СНИЛС № [СНИЛС_1] и лот {k}", ["112-233-445 {dd}"]),
    "mask_two_addresses": (
        "customer",
        "c_custkey",
        "адрес регистрации: г. Тула, ул. Б. Полянка, д. {house}. Фактический адрес: г. Орёл, ул. Лесная, д. {house}. Контакт есть",
        "адрес регистрации: [АДРЕС_1]. Фактический адрес: [АДРЕС_2]. Контакт есть",
        ["г. Тула, ул. Б. Полянка, д. {house}", "г. Орёл, ул. Лесная, д. {house}"],
    ),
    "mask_far_label": ("customer", "c_custkey", "БИК банка получателя по договору поставки оборудования и материалов от прошлого года для расчётов сторон {d9} верен", "БИК банка получателя по договору поставки оборудования и материалов от прошлого года для расчётов сторон [БИК_1] верен", ["{d9}"]),
    "mask_far_tax_label": ("customer", "c_custkey", "ИНН (указан в реестре) лица которое подписало договор поставки оборудования и материалов за прошлый год № {d12} верен", "ИНН (указан в реестре) лица которое подписало договор поставки оборудования и материалов за прошлый год № [ИНН_ФЛ_1] верен", ["{d12}"]),
    "mask_precedence": (
        "customer",
        "c_custkey",
        "{a20} {d15} {d13} {d12} {d10} 77:18:{d7}:{d5}-77/060/2025-1 77:18:{d7}:{d5}",
        "[СЧЁТ_1] [ОГРН_1] [ОГРН_2] [ИНН_ФЛ_1] [ИНН_ЮЛ_1] [ЕГРН_1] [КАДАСТР_1]",
        ["77:18:{d7}:{d5}-77/060/2025-1", "77:18:{d7}:{d5}", "{a20}", "{d15}", "{d13}", "{d12}", "{d10}"],
    ),
    "mask_labelled_number_of_other_length": ("customer", "c_custkey", "КПП {d9} и {d9}, лот {k}", "КПП [КПП_1] и {d9}, лот {k}", ["{d9}"]),
}


def expression(template: str) -> str:
    """The template as an SQL expression over k."""
    out = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            out.append(PARTS[piece])
        elif piece:
            out.append("'" + piece.replace("'", "''") + "'")
    return f"concat({', '.join(out)})" if out else "''"
