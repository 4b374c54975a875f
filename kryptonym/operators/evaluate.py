"""Quality metrics of masking: leaks, over-masking, preservation, reproducibility, gates and verdicts."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kryptonym.functions.text import squeezed

# What counts as a telling token, and what a placeholder looks like to the metrics.
TOKEN = r"[А-Яа-яЁёA-Za-z]{4,}|\d{3,}"
TELLS_NOTHING = "www http https mail email".split()
SHOWN = r"\[[A-ZА-ЯЁ][A-ZА-ЯЁ_]*_?\d*\]"
RECOGNISED, CONFUSED = 8, 2
OWN_THESIS, OTHER_THESIS = 9, 2
CYRILLIC_SHARE = 0.9


def telling_tokens(span: Column) -> Column:
    return F.filter(F.regexp_extract_all(span, F.lit("(?d)" + TOKEN), F.lit(0)), lambda t: ~F.lower(t).isin(*TELLS_NOTHING))


def is_masked(span: Column, output: Column) -> Column:
    """No telling token of the span is left in the output; true if it has none."""
    return F.forall(telling_tokens(span), lambda t: ~F.contains(F.lower(output), F.lower(t)))


def is_kept(piece: Column, output: Column) -> Column:
    return F.contains(F.lower(squeezed(output)), F.lower(squeezed(piece)))


def preservation(original: Column, output: Column) -> Column:
    """struct<kept, broken_at>: the pieces between placeholders stand in the original, in order and apart; else the first that doesn't."""
    source = F.lower(squeezed(original))
    pieces = F.filter(F.transform(F.split(output, SHOWN, -1), lambda p: F.lower(squeezed(p))), lambda p: p != "")
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("broken"))

    def step(state: Column, piece: Column) -> Column:
        found = F.call_function("locate", piece, source, state["at"])
        moved = F.struct((found + F.length(piece)).alias("at"), F.lit("").alias("broken"))
        lost = F.struct(state["at"].alias("at"), F.substring(piece, 1, 40).alias("broken"))
        return F.when(state["broken"] != "", state).when(found > 0, moved).otherwise(lost)

    return F.aggregate(pieces, start, step, lambda s: F.struct((s["broken"] == "").alias("kept"), s["broken"].alias("broken_at")))


def scored(corpus: DataFrame, runs: DataFrame) -> DataFrame:
    """A row for each text of the corpus that has runs.

    corpus: id, grp, text, must_mask, must_stay (arrays). runs: id, run, output [, seconds]. The first run decides the
    quality, all of them whether the output is reproducible (null for a single run).
    """
    seconds = F.min_by("seconds", "run") if "seconds" in runs.columns else F.lit(None).cast("double")
    first = runs.groupBy("id").agg(F.min_by("output", "run").alias("output"), F.count("*").alias("n_runs"), (F.min(F.xxhash64(squeezed(F.col("output")))) == F.max(F.xxhash64(squeezed(F.col("output"))))).alias("same"), seconds.alias("seconds"))
    out = corpus.join(first, "id")
    missed = F.filter("must_mask", lambda s: ~is_masked(s, F.col("output")))
    false_alarms = F.filter("must_stay", lambda s: ~is_kept(s, F.col("output")))
    p = preservation(F.col("text"), F.col("output"))
    return out.select("id", "grp", F.size("must_mask").alias("n_spans"), missed.alias("missed"), false_alarms.alias("false_alarms"), p["kept"].alias("preserved"), p["broken_at"].alias("broken_at"), "n_runs", F.when(F.col("n_runs") > 1, F.col("same")).alias("reproducible"), "seconds")


def summary(scores: DataFrame) -> DataFrame:
    """For each group: spans, missed, recall to three places (null without spans), false alarms, texts and texts preserved."""
    spans, missed = F.sum("n_spans"), F.sum(F.size("missed"))
    return scores.groupBy("grp").agg(spans.alias("spans"), missed.alias("missed"), F.round((spans - missed) / F.nullif(spans, F.lit(0)), 3).alias("recall"), F.sum(F.size("false_alarms")).alias("false_alarms"), F.count("*").alias("texts"), F.count_if("preserved").alias("preserved"), F.count_if(F.coalesce("reproducible", F.lit(False))).alias("reproducible"))


def warm_seconds(scores: DataFrame, order: str = "id") -> DataFrame:
    """The mean seconds of all texts but the first; texts without a time don't count."""
    timed = F.col("seconds") > 0
    first = F.min_by(F.when(timed, F.col("seconds")), order)
    total, n = F.sum(F.when(timed, F.col("seconds"))) - F.coalesce(first, F.lit(0.0)), F.count_if(timed) - first.isNotNull().cast("int")
    return scores.agg(F.coalesce(F.round(F.when(n > 0, total / n), 2), F.lit(0.0)).alias("seconds"))


def cyrillic_share(text: Column) -> Column:
    """Letters from U+0400 to U+04FF among all letters; 0 without letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.coalesce(F.regexp_count(text, F.lit(r"[Ѐ-ӿ&&\p{L}]")) / F.nullif(letters, F.lit(0)), F.lit(0.0))


def recognised_number(answer: Column, candidates: int) -> Column:
    """The first whole number of a judge's answer, 0 if there is none or it is no candidate's."""
    n = F.regexp_extract(answer, r"\d+", 0).try_cast("int")
    return F.when((n >= 1) & (n <= candidates), n).otherwise(0)


def says_yes(answer: Column, lenient: bool = False) -> Column:
    word = F.upper(F.trim(answer))
    return F.contains(word, F.lit("ДА")) if lenient else F.startswith(word, F.lit("ДА"))


def judge_gate(answers: DataFrame) -> DataFrame:
    """answers: on_positive, on_negative (booleans). A judge passes with at least 8 positive hits and at most 2 negative."""
    a, b = F.count_if("on_positive"), F.count_if("on_negative")
    return answers.agg(a.alias("positive"), b.alias("negative"), ((a >= RECOGNISED) & (b <= CONFUSED)).alias("passed"))


def meaning_gate(answers: DataFrame) -> DataFrame:
    """answers: own, other (booleans): at least 9 own theses accepted and at most 2 of other texts."""
    a, b = F.count_if("own"), F.count_if("other")
    return answers.agg(a.alias("own"), b.alias("other"), ((a >= OWN_THESIS) & (b <= OTHER_THESIS)).alias("passed"))


def both_gates(recognition: DataFrame, meaning: DataFrame) -> DataFrame:
    """The judge's two gates in one row: it may judge if it passes both."""
    a = judge_gate(recognition).select("positive", "negative", F.col("passed").alias("recognises"))
    b = meaning_gate(meaning).select("own", "other", F.col("passed").alias("understands"))
    one = lambda df: df.withColumn("row", F.lit(1))
    return one(a).join(one(b), "row").drop("row").withColumn("passed", F.col("recognises") & F.col("understands"))


def next_thesis(df: DataFrame, order: str, thesis: str) -> DataFrame:
    """Each row with the next row's thesis in the order; the first follows the last. By a join on numbered rows."""
    from .numbering import checkpointed, numbered

    rows = checkpointed(numbered(df, [], [order]))
    n = rows.count()
    after = rows.select(F.when(F.col("n") == 1, F.lit(n)).otherwise(F.col("n") - 1).alias("n"), F.col(thesis).alias("next_thesis"))
    return rows.join(after, "n").drop("n")


def verdict(results: DataFrame) -> DataFrame:
    """results: recognised_masked, recognised_abstract, meaning_abstract (booleans). Abstraction is accepted if at
    least two texts fewer are recognised and at least eight keep their meaning."""
    m, a, s = (F.count_if(c) for c in ("recognised_masked", "recognised_abstract", "meaning_abstract"))
    fewer, kept = a <= m - 2, s >= 8
    return results.agg(m.alias("masked"), a.alias("abstract"), s.alias("meaning"), fewer.alias("fewer_recognised"), kept.alias("meaning_kept"), (fewer & kept).alias("accepted"))


def judged(rows: DataFrame, prompt: Column, call, out_col: str = "answer") -> DataFrame:
    """Answers of a model to a prompt column. `call(list of prompts) -> list of answers` runs on the workers."""

    def run(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in prompts:
            yield pd.Series(call(list(p)), dtype=object)

    return rows.withColumn(out_col, F.pandas_udf(run, "string")(prompt))


class HttpModel:
    """A call for `judged`: each prompt is posted to a model's server, with temperature 0 and a fixed seed; its answer is the field `response`."""

    def __init__(self, url: str, model: str, seed: int = 42, seconds: float = 120):
        self.url, self.model, self.seed, self.seconds = url, model, seed, seconds

    def __call__(self, prompts: list[str]) -> list[str]:
        return [self._one(p) for p in prompts]

    def _one(self, prompt: str) -> str:
        body = {"model": self.model, "prompt": prompt, "stream": False, "options": {"temperature": 0, "seed": self.seed}}
        asked = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(asked, timeout=self.seconds) as answer:
            return json.loads(answer.read())["response"]


def rejudged(outputs: DataFrame, corpus: DataFrame) -> DataFrame:
    return outputs.join(corpus, "id")

