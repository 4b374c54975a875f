"""DuckDB SQL that masks by RE2 patterns: the span kernel once more, for checking."""

from __future__ import annotations

from kryptonym.functions.rules import BY_ID


def re2(pattern: str, any_case: bool) -> str:
    """A pattern without look-around in RE2's syntax, where \\w has ASCII only."""
    out = pattern.replace(r"[\w\s.-]", r"[\pL\pN_\s.-]").replace(r"[\s\w()]", r"[\s\pL\pN_()]")
    return ("(?i)" if any_case else "") + out


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def kernel(source: str, key: str, rule_ids: list[str], name: str = "t") -> str:
    """WITH-steps that end in a table `masked` of (key, text_masked, known_<rule> lists)."""
    steps = [f"{name}0 AS (SELECT {key}, coalesce(text, '') AS t{''.join(f', []::VARCHAR[] AS known_{r}' for r in rule_ids)} FROM ({source}))"]
    n = 0
    for rule_id in rule_ids:
        rule = BY_ID[rule_id]
        for parts in rule.forms:
            p = quoted(re2("".join(f"({g})" for g in parts), rule.any_case))
            others = "".join(f", known_{r}" for r in rule_ids if r != rule_id)
            steps.append(f"{name}{n}a AS (SELECT {key}, known_{rule_id}{others}, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}, 1) AS pre, regexp_extract_all(t, {p}, 2) AS val, regexp_extract_all(t, {p}, 3) AS suf FROM {name}{n})")
            steps.append(f"{name}{n}b AS (SELECT * REPLACE (list_concat(known_{rule_id}, list_filter(val, lambda v, i: list_position(val, v) = i AND NOT list_contains(known_{rule_id}, v))) AS known_{rule_id}) FROM {name}{n}a)")
            token = f"'[{rule.label}_' || list_position(known_{rule_id}, val[i]) || ']'"
            steps.append(f"{name}{n + 1} AS (SELECT {key}, known_{rule_id}{others}, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || CASE WHEN i <= len(val) THEN pre[i] || {token} || suf[i] ELSE '' END), '') AS t FROM {name}{n}b)")
            n += 1
    steps.append(f"masked AS (SELECT {key}, t AS text_masked{''.join(f', known_{r}' for r in rule_ids)} FROM {name}{n})")
    return "WITH " + ",\n".join(steps)
