"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, blocks, free_name, prepare

BUCKETS = 1 << 16
#: Pseudo-count of every bucket.
ALPHA = 0.5
#: Grams that a text's evidence counts for at most in the score.
TEMPER = 64
#: Grams scored at once.
STEP = 1 << 16
UNKNOWN = "und"
#: Languages of a model; the driver holds a number for each of them and each bucket.
MOST_LANGUAGES = 1024


@lru_cache(1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every gram of one to three code points around a letter, and whether each text has a letter.

    Texts are lower-cased; all that is no letter is one and the same gap.
    """
    data, at = as_bytes(pc.utf8_lower(array))
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4")
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    at = points[at]
    is_letter = letters()[code]
    c = np.zeros(len(code) + 2, np.uint32)
    c[1:-1] = np.where(is_letter, code, 0)
    row = np.repeat(np.arange(len(array)), np.diff(at))
    inner = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(code))]
    before, after = c[:-2].copy(), c[2:].copy()
    before[inner] = 0
    after[inner - 1] = 0
    i = np.flatnonzero(is_letter)
    x, y, z, row = before[i], c[1:-1][i], after[i], row[i]
    one = y * np.uint32(0x9E3779B1)
    two = one + (z + np.uint32(1)) * np.uint32(0x85EBCA6B)
    three = two + (x + np.uint32(7)) * np.uint32(0xC2B2AE35)
    found = np.stack([one, two, three], 1)
    found = ((found ^ found >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int32)
    has = np.zeros(len(array), bool)
    has[row] = True
    return np.repeat(row, 3), found.ravel(), has


@dataclass
class Model:
    """log P(language), log P(bucket | language) as a matrix with a row for each bucket."""

    names: list[str]
    prior: np.ndarray
    matrix: np.ndarray

    def predict(self, array: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(array)
        if not self.names:
            return [UNKNOWN] * n, np.zeros(n)
        row, bucket, has = ngrams(array)
        total = np.zeros((n, len(self.names)))
        for k in range(0, len(row), STEP):
            r = row[k : k + STEP]
            first = np.concatenate(([0], np.flatnonzero(np.diff(r)) + 1))
            total[r[first]] += np.add.reduceat(self.matrix[bucket[k : k + STEP]], first, axis=0, dtype=np.float64)
        count = np.bincount(row, minlength=n)
        best = np.where(has, (total + self.prior).argmax(1), -1)
        scaled = (total + self.prior) * np.minimum(1, TEMPER / np.maximum(count, 1))[:, None]
        likely = np.exp(scaled - scaled.max(1, keepdims=True))
        score = np.where(has, (likely / likely.sum(1, keepdims=True))[np.arange(n), best], 0.0)
        return [self.names[b] if b >= 0 else UNKNOWN for b in best], score


def fit(df: DataFrame, lang_col: str = "lang", text_col: str = "text", alpha: float = ALPHA) -> Model:
    """A model from every row with a language: grams are counted in each partition, then added up by Spark.

    The driver gets a number for each language and bucket; a column of more than MOST_LANGUAGES values is an error. Rows
    with null language are not used, null and empty texts count for their language's share only, repeated rows each;
    without rows the model knows no language and predicts `und`. Other columns are ignored.
    """
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for block in blocks(batches):
            names = block.column(0).to_pylist()
            known = {x: k for k, x in enumerate(dict.fromkeys(names))}
            index = np.array([known[x] for x in names])
            row, bucket, _ = ngrams(block.column(1))
            for name, k in known.items():
                own = np.bincount(bucket[index[row] == k], minlength=BUCKETS)
                sums[name] = sums[name] + own if name in sums else own
                rows[name] = rows.get(name, 0) + int((index == k).sum())
        for name, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(used) + 1), pa.string()), pa.array([-1, *used.tolist()], pa.int32()), pa.array([rows[name], *total[used].tolist()], pa.int64())], names=["lang", "bucket", "n"])

    own = df.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    if own.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError("too many languages")
    counts = own.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts.lang.unique())
    if not names:
        return Model([], np.zeros(0), np.zeros((BUCKETS, 0)))
    at = {x: k for k, x in enumerate(names)}
    matrix, prior = np.full((BUCKETS, len(names)), alpha), np.zeros(len(names))
    col = counts.lang.map(at).to_numpy()
    is_gram = (counts.bucket >= 0).to_numpy()
    prior[col[~is_gram]] = counts.n.to_numpy()[~is_gram]
    matrix[counts.bucket.to_numpy()[is_gram], col[is_gram]] += counts.n.to_numpy()[is_gram]
    return Model(names, np.log(prior / prior.sum()), np.log(matrix / matrix.sum(0)).astype(np.float32))


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows with lang_pred and score (0 to 1) of the whole text; `und` and 0 for null text or one without a letter.

    Of equally likely languages the first by name is taken. Repeated rows each get theirs; an empty table gives none;
    columns of these names are replaced, all others stay.
    """
    sent = prepare(df.sparkSession).sparkContext.broadcast(model)

    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], names=["text"])
            names, scores = [], [np.zeros(0)]
            for block in blocks(iter([batch])):
                a, b = sent.value.predict(block.column(0))
                names += a
                scores.append(b)
            yield pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": np.concatenate(scores)})

    guess = F.pandas_udf(predicted, "lang_pred string, score double")
    name = free_name(df, "guess")
    made = df.withColumn(name, guess(F.col(text_col).cast("string")))
    return made.withColumns({"lang_pred": F.col(name)["lang_pred"], "score": F.col(name)["score"]}).drop(name)
