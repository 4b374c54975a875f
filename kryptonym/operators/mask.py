"""Masking, numbering and restoring as DataFrame operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kryptonym.functions.columns import inner
from kryptonym.functions.rules import BY_ID, RULES, chosen
from kryptonym.functions.text import PLACEHOLDER, collapse_digits, may_be_loose

from .masker import PASSES, Config, Masker
from .numbering import checkpointed, joined_hot, numbered

KEY = "struct<ord: int, placeholder: string, type_id: string, type: string, original: string>"
MASKED = f"text string, keys array<{KEY}>"


def masked_column(text: Column, config: Config | None = None) -> Column:
    """struct<text, keys> of each text by itself: every row starts its numbering anew.

    Each pattern runs over what the earlier ones left and its numbers depend on theirs, so all of them run in one
    Arrow-batched pass; layers are loaded once in each worker. Text never appears in an error.
    """
    settings = config or Config()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out, keys = [], []
            for text in texts:
                masker = Masker(settings)
                try:
                    out.append(masker.mask(None if text is None or text != text else text))
                except Exception as e:
                    raise RuntimeError(f"masking failed: {type(e).__name__}") from None
                keys.append(masker.keys)
            yield pd.DataFrame({"text": pd.Series(out, dtype=object), "keys": pd.Series(keys, dtype=object)})

    return F.pandas_udf(run, MASKED)(text.cast("string"))


def native_masked(df: DataFrame, text_col: str, enabled: set[str], composed: bool = False) -> DataFrame:
    """The same for a few rules of patterns alone, by built-in functions: adds columns text_masked and keys.

    For each pattern the matches are taken apart, new values are appended to those known of the type, and the text is
    put together again around `[LABEL_n]`, n being a value's place among them. Text without a match is passed on. Spaced
    digits are joined first. Letters can't be composed (NFC) by built-in functions: rows that hold a character that
    composed text lacks go through `masked_column`; `composed` says that there are none, so that the table is read once.
    """
    rules = chosen(frozenset(enabled))
    for rule in rules:
        rule.java()  # a rule that takes more than patterns is an error
    if composed:
        return _native(df, text_col, rules)
    apart = may_be_loose(F.col(text_col))
    name = inner(df, "_m")[0]
    rest = df.where(apart).withColumn(name, masked_column(F.col(text_col), Config(enabled=frozenset(enabled))))
    rest = rest.select(*df.columns, F.col(name)["text"].alias("text_masked"), F.coalesce(F.col(name)["keys"], F.array()).alias("keys"))
    return _native(df.where(~apart), text_col, rules).unionByName(rest)


def _native(df: DataFrame, text_col: str, rules: list) -> DataFrame:
    space = r"(?U)^\s+|\s+$"
    t, found, pre, gap, bare, *known = inner(df, "_t", "_val", "_pre", "_gap", "_bare", *(f"_k_{r.id}" for r in rules))
    out = df.withColumn(t, collapse_digits(F.coalesce(F.col(text_col), F.lit(""))))
    for rule, k in zip(rules, known):
        out = out.withColumn(k, F.array().cast("array<string>"))
        for form, pattern in zip(rule.forms, rule.java()):
            p = F.lit(pattern)
            # what follows the value is looked at, never taken
            out = out.withColumn(found, F.regexp_extract_all(t, p, F.lit(2)))
            hit = F.size(found) > 0
            before = F.regexp_extract_all(t, p, F.lit(1)) if form[0] else F.transform(found, lambda v: F.lit(""))
            out = out.withColumns({pre: F.when(hit, before), gap: F.when(hit, F.split(t, pattern, -1)), bare: F.when(hit, F.transform(found, lambda v: F.regexp_replace(v, space, "")))})
            more = F.array_except(F.array_distinct(F.filter(bare, lambda v: v != "")), k)
            out = out.withColumn(k, F.when(hit, F.concat(k, more)).otherwise(F.col(k)))
            tokens = F.zip_with(found, bare, _token(rule.label, F.col(k)))
            inside = F.zip_with(pre, tokens, lambda a, b: F.concat(a, b))
            text = F.array_join(F.zip_with(gap, inside, lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")
            out = out.withColumn(t, F.when(hit, text).otherwise(F.col(t)))
    keys = [F.transform(F.col(k), _key(r.id, r.label)) for r, k in zip(rules, known)]
    joined = F.transform(F.concat(*keys), lambda k, i: F.struct((i + 1).alias("ord"), k["placeholder"].alias("placeholder"), k["type_id"].alias("type_id"), k["type"].alias("type"), k["original"].alias("original")))
    return out.select(*df.columns, F.when(F.col(text_col).isNotNull(), F.col(t)).alias("text_masked"), joined.alias("keys"))


def _token(label: str, known: Column):
    def token(value: Column, bare: Column) -> Column:
        made = F.concat(F.lit(f"[{label}_"), F.array_position(known, bare).cast("string"), F.lit("]"))
        return F.when(bare == "", value).otherwise(F.concat(F.regexp_extract(value, r"(?U)^\s*", 0), made, F.regexp_extract(value, r"(?U)\s*$", 0)))

    return token


def _key(type_id: str, label: str):
    def key(value: Column, i: Column) -> Column:
        placeholder = F.concat(F.lit(f"[{label}_"), (i + 1).cast("string"), F.lit("]"))
        return F.struct(placeholder.alias("placeholder"), F.lit(type_id).alias("type_id"), F.lit(label).alias("type"), value.alias("original"))

    return key


def restored(text: Column, keys: Column) -> Column:
    """The text with all placeholders of keys put back, nested ones too; as many passes as `masker.restore`."""

    def one_pass(t: Column) -> Column:
        return F.aggregate(keys, t, lambda u, k: F.replace(u, k["placeholder"], k["original"]))

    return F.aggregate(F.sequence(F.lit(1), F.lit(PASSES)), text, lambda t, _: one_pass(t))


def swapped(text: Column, names: Column) -> Column:
    """The text with every placeholder that the map knows replaced at once."""
    gaps, found = F.split(text, PLACEHOLDER, -1), F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))
    return F.array_join(F.zip_with(gaps, found, lambda g, t: F.concat(g, F.coalesce(names[t], t, F.lit("")))), "")


def mask(df: DataFrame, text_col: str = "text", id_cols: tuple[str, ...] = ("doc_id",), scope: str = "row", group_cols: tuple[str, ...] = (), config: Config | None = None) -> DataFrame:
    """The rows with text_masked and keys.

    scope `row`: each row numbers its values by itself. `group`: rows of equal group_cols share numbers, `batch`: all
    rows do, in the order of id_cols, which must tell the rows apart. Rows are then masked by themselves first;
    only their keys are shuffled, as one row for each distinct value, and numbered over a range partitioning.
    Null text stays null and has no keys.
    """
    name = inner(df, "_m")[0]
    made = df.withColumn(name, masked_column(F.col(text_col), config))
    made = made.select(*df.columns, F.col(name)["text"].alias("text_masked"), F.coalesce(F.col(name)["keys"], F.array()).alias("keys"))
    if scope == "row":
        return made
    if scope not in ("group", "batch"):
        raise ValueError(f"unknown scope: {scope}")
    return renumbered(made, list(id_cols), list(group_cols) if scope == "group" else [])


def renumbered(made: DataFrame, id_cols: list[str], group_cols: list[str]) -> DataFrame:
    """The rows of the row scope with numbers shared in each group. Texts are masked once; those without a key are not dealt."""
    made = checkpointed(made)
    ids = [c for c in dict.fromkeys([*group_cols, *id_cols])]
    keyed = made.where(F.size("keys") > 0).select(*(F.col(c).alias(f"i{k}") for k, c in enumerate(ids)), "keys")
    own, group = [f"i{k}" for k in range(len(ids))], [f"i{k}" for k in range(len(group_cols))]
    rank = F.struct(*(f"i{ids.index(c)}" for c in id_cols), "pos")
    full = keyed.select(*own, F.explode("keys").alias("k"), "keys").select(*own, F.col("k.ord").alias("pos"), F.col("k.placeholder").alias("local"), F.col("k.type").alias("type"), F.col("k.type_id").alias("type_id"), F.col("k.original").alias("value"), restored(F.col("k.original"), F.col("keys")).alias("full"))
    # a group may be null: as text of its parts it is a key like any other
    full = checkpointed(full.withColumn("g", F.to_json(F.array(*(F.col(c).cast("string") for c in (*group, "type"))))))
    first = full.groupBy("g", "type", "type_id", "full").agg(F.min(rank).alias("at"))
    number = numbered(first, ["g"], ["at", "type_id", "full"])
    number = number.select("g", "type_id", "full", F.concat(F.lit("["), F.col("type"), F.lit("_"), F.col("n").cast("string"), F.lit("]")).alias("global"), F.col("at").alias("first_at"))
    named = joined_hot(full, number, ["g", "type_id", "full"])
    one = F.struct("pos", "local", "global", "type_id", "type", "value", rank.eqNullSafe(F.col("first_at")).alias("is_first"))
    lists = named.groupBy(*own).agg(F.array_sort(F.collect_list(one)).alias("named"))
    lists = lists.select(F.struct(*own).alias("who"), "named")
    who, known, names = inner(made, "_who", "_named", "_names")
    lists = lists.select(F.col("who").alias(who), F.col("named").alias(known))
    mine = F.struct(*(F.col(c).alias(f"i{k}") for k, c in enumerate(ids)))
    held = made.where(F.size("keys") > 0)
    joined = held.withColumn(who, mine).join(lists, who).withColumn(names, F.map_from_entries(F.transform(known, lambda x: F.struct(x["local"], x["global"]))))
    keys = F.transform(known, lambda x: F.struct(x["pos"].alias("ord"), x["global"].alias("placeholder"), x["type_id"].alias("type_id"), x["type"].alias("type"), swapped(x["value"], F.col(names)).alias("original")))
    rest = [c for c in made.columns if c not in ("text_masked", "keys")]
    done = joined.select(*rest, swapped(F.col("text_masked"), F.col(names)).alias("text_masked"), keys.alias("keys"))
    return done.union(made.where(F.size("keys") == 0).select(*rest, "text_masked", "keys"))


def key_table(masked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """placeholder, type_id, type, original: one row for each key (within `by`)."""
    each = masked.select(*by, F.explode("keys").alias("k")).select(*by, "k.placeholder", "k.type_id", "k.type", "k.original")
    return each.distinct()


def restore(df: DataFrame, text_col: str, keys_col: str = "keys") -> DataFrame:
    return df.withColumn("text_restored", restored(F.col(text_col), F.col(keys_col)))


def stats(masked: DataFrame, text_col: str = "text_masked", by: tuple[str, ...] = ()) -> DataFrame:
    """For each type: distinct values (keys) and replacements (placeholders in the texts), with its report label."""
    each = masked.select(*by, F.explode("keys").alias("k"), F.col(text_col).alias("t"))
    shown = F.size(F.split("t", F.concat(F.lit(r"\Q"), F.col("k.placeholder"), F.lit(r"\E")), -1)) - 1
    return each.groupBy(*by, F.col("k.type_id").alias("type_id")).agg(F.count("*").alias("n_values"), F.sum(shown).cast("long").alias("n_replaced")).withColumn("label", report_label(F.col("type_id")))


def report_label(type_id: Column) -> Column:
    out = F.upper(type_id)
    for r in RULES:
        out = F.when(type_id == r.id, BY_ID[r.id].label).otherwise(out)
    return out
