"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RollingHash, as_bytes, blocks, mixed, prepare, word_spans

#: Labelled rows of each label that the model is fitted on, those with the lowest hash of their id.
ROWS_PER_LABEL = 3000
#: Buckets of the hashed terms.
BUCKETS = 1 << 20
#: Terms that fewer fitted rows hold are not looked at.
LEAST_ROWS = 2
#: Terms that enter the machine for themselves: those whose log odds ratio is furthest from 0 in its deviations, at least Z.
TERMS, Z = 4096, 2.0
#: Terms that enter as halves of pairs: those with the largest parts in the leading directions of co-occurrence with what
#: single terms leave unexplained, if some pair of them deviates by PAIR_Z at least.
PAIRED, PAIR_Z = 512, 6.0
FACTORS = 4
#: Leading bytes of a word that are terms besides the word.
PREFIXES = (4, 5, 6)
ROUNDS = 200
#: Values summed at once by the fit.
CHUNK = 1 << 21
#: Weight of the squared parameters, on average over them.
L2 = 1.0

#: What separates words: every ASCII byte but letters, digits and the apostrophe.
BREAK = np.zeros(256, bool)
BREAK[:128] = True
BREAK[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("0"), ord("9") + 1), ord("'")]] = False


def terms(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every term of every text: each lower-cased word and its prefixes, with repeats."""
    data, at = as_bytes(pc.utf8_lower(array))
    starts, ends, row = word_spans(data, at, BREAK)
    if not len(starts):
        return row, np.zeros(0, np.int64)
    rolling = RollingHash(data)
    rows, found = [row], [rolling.of(starts, ends)]
    for k in PREFIXES:
        long = ends - starts > k
        rows.append(row[long])
        found.append(mixed(rolling.of(starts[long], starts[long] + k) + np.uint64(k)))
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(44)).astype(np.int64) & (BUCKETS - 1)


@dataclass
class Machine:
    """w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j over the kept terms that a text holds."""

    place: np.ndarray  # bucket -> kept term or -1
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, array: pa.Array) -> np.ndarray:
        row, bucket = terms(array)
        kept = self.place[bucket]
        held = kept >= 0
        pairs = np.unique(row[held] * len(self.w) + kept[held]) if len(self.w) else np.zeros(0, np.int64)
        row, kept = (pairs // len(self.w), pairs % len(self.w)) if len(self.w) else (pairs, pairs)
        return sigmoid(margin(len(array), row, kept, self.w0, self.w, self.v)[0])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def margin(n: int, row: np.ndarray, kept: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score before the sigmoid, sum of factors) of each of n rows."""
    out = np.full(n, w0) + np.bincount(row, w[kept], n)
    sums = np.stack([np.bincount(row, v[kept, f], n) for f in range(v.shape[1])], 1)
    squares = np.bincount(row, (v[kept] ** 2).sum(1), n)
    return out + 0.5 * ((sums**2).sum(1) - squares), sums


class Held:
    """Which row holds which term, in the order of the rows and in that of the terms, for sums over either."""

    def __init__(self, n: int, row: np.ndarray, term: np.ndarray, size: int):
        self.n, self.size = n, size
        self.by_row, by = self._cut(row, term), np.argsort(term, kind="stable")
        self.by_term = self._cut(term[by], row[by])

    @staticmethod
    def _cut(of: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
        return of[first], first, what

    def _sums(self, cut: tuple, values: np.ndarray, size: int) -> np.ndarray:
        (of, first, what), out = cut, np.zeros((size, values.shape[1]), np.float32)
        ends = np.append(first[1:], len(what))
        k = 0
        while k < len(of):  # as many groups as make some CHUNK values
            to = max(k + 1, int(np.searchsorted(ends, first[k] + CHUNK)))
            part = values[what[first[k] : ends[to - 1]]]
            out[of[k:to]] = np.add.reduceat(part, first[k:to] - first[k], axis=0)
            k = to
        return out

    def of_rows(self, values: np.ndarray) -> np.ndarray:
        """For each row the sum of its terms' values, (terms, any number) float32."""
        return self._sums(self.by_row, values, self.n)

    def of_terms(self, values: np.ndarray) -> np.ndarray:
        """For each term the sum of its rows' values."""
        return self._sums(self.by_term, values, self.size)


def fit_machine(n: int, row: np.ndarray, kept: np.ndarray, label: np.ndarray, size: int, factors: int = FACTORS, rounds: int = ROUNDS, l2: float = L2) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss, each label weighing half, by Adam over all rows. row ascends."""
    rng, held = np.random.default_rng(0), Held(n, row, kept, size)
    base, p = np.zeros(1), np.concatenate([np.zeros((size, 1)), rng.normal(0, 0.05, (size, factors))], 1).astype(np.float32)  # w and v
    weight = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum()))
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (base, p)]
    for t in range(1, rounds + 1):
        sums = held.of_rows(np.concatenate([p, (p[:, 1:] ** 2).sum(1, keepdims=True)], 1))
        x = base[0] + sums[:, 0] + 0.5 * ((sums[:, 1:-1] ** 2).sum(1) - sums[:, -1])
        g = (weight * (sigmoid(x) - label)).astype(np.float32)[:, None]
        grad = held.of_terms(np.concatenate([g, g * sums[:, 1:-1]], 1))
        grad[:, 1:] -= p[:, 1:] * grad[:, :1]
        for q, d, (m, s) in zip((base, p), (g.sum(0), grad + l2 * p / max(size, 1)), state):
            m += 0.1 * (d - m)
            s += 0.001 * (d**2 - s)
            q -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return float(base[0]), p[:, 0].astype(float), p[:, 1:].astype(float)


def standing_out(row: np.ndarray, term: np.ndarray, label: np.ndarray, size: int) -> np.ndarray:
    """How many deviations each term's log odds ratio of the labels lies from 0."""
    ones, zeros = np.bincount(term[label[row] == 1], minlength=size), np.bincount(term[label[row] == 0], minlength=size)
    a, b, n1, n0 = ones + 0.5, zeros + 0.5, label.sum(), (1 - label).sum()
    return np.abs(np.log(a / (n1 - ones + 0.5)) - np.log(b / (n0 - zeros + 0.5))) / np.sqrt(1 / a + 1 / b)


def only(row: np.ndarray, term: np.ndarray, size: int, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The occurrences of kept terms, which are numbered anew in their order."""
    place = np.full(size, -1)
    place[kept] = np.arange(len(kept))
    use = place[term] >= 0
    return row[use], place[term[use]]


def unexplained(n: int, row: np.ndarray, term: np.ndarray, label: np.ndarray, size: int, kept: np.ndarray, factors: int) -> np.ndarray:
    """The label less its probability for each row, by a machine over kept terms fitted on the other half of the rows."""
    row, term = only(row, term, size, kept)
    out, half = np.zeros(n), np.arange(n) % 2
    for h in (0, 1):
        own = np.flatnonzero(half != h)
        at = np.full(n, -1)
        at[own] = np.arange(len(own))
        use = at[row] >= 0
        w0, w, v = fit_machine(len(own), at[row[use]], term[use], label[own], len(kept), factors, ROUNDS // 2)
        out[half == h] = (label - sigmoid(margin(n, row, term, w0, w, v)[0]))[half == h]
    return out


def paired(n: int, row: np.ndarray, term: np.ndarray, rest: np.ndarray, size: int, most: int = PAIRED, least: float = PAIR_Z, directions: int = 4, rounds: int = 8) -> np.ndarray:
    """Terms in pairs that occur together in rows whose rest (what is unexplained) is of one sign.

    The matrix of rest-weighted co-occurrences is never built: its leading directions are found by power iteration, each time
    kept to the `most` terms of the largest parts. Only between those terms are pairs counted.
    """
    if not size:
        return np.zeros(0, np.int64)
    rng, held = np.random.default_rng(0), Held(n, row, term, size)
    rest = rest.astype(np.float32)
    own, v = held.of_terms(rest[:, None]), rng.normal(size=(size, directions)).astype(np.float32)
    for _ in range(rounds):
        made = held.of_terms(rest[:, None] * held.of_rows(v)) - own * v
        kept = np.argsort(-np.abs(made).max(1), kind="stable")[:most]
        v = np.zeros_like(made)
        v[kept] = made[kept]
        v = np.linalg.qr(v)[0]
        v = v[:, np.abs(v).max(0) > 0]
    kept = np.sort(kept)
    row, term = only(row, term, size, kept)
    dense = np.zeros((n, len(kept)), np.float32)
    dense[row, term] = 1
    together = dense.T @ (dense * rest[:, None])
    spread = np.sqrt(dense.T @ (dense * (rest**2)[:, None]) + 1e-6)
    far = np.abs(together) / spread
    far[dense.T @ dense < 4] = 0
    np.fill_diagonal(far, 0)
    return kept[(far >= least).any(1)]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = ROWS_PER_LABEL, factors: int = FACTORS) -> Machine:
    """A machine fitted on the labelled rows, at most `most` ids of each label; those of the lowest id hash.

    Every term of LEAST_ROWS rows is looked at, alone and in pairs: what tells the labels apart by itself enters the
    machine, and so does what does so only together with another term. Which of them count is left to the fit.

    Ids without a label (null), with another label than 0 and 1, with both or without a document are not used; of
    several documents of one id the one of the smallest terms is used, so the driver gets 2 * most rows at most.
    Null and empty texts hold no term. Without rows of both labels the machine knows no term and scores every text by the
    labels' mean (0 without labels). Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null")
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("id", "label")
    order = F.xxhash64("id")
    chosen = known.where("label = 1").orderBy(order, "id").limit(most).union(known.where("label = 0").orderBy(order, "id").limit(most))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            row, bucket = terms(block.column(2))
            pairs = np.unique(row * BUCKETS + bucket)
            row, bucket = pairs // BUCKETS, (pairs % BUCKETS).astype(np.int32)
            cut = np.searchsorted(row, np.arange(block.num_rows + 1)).tolist()
            packed = [bucket[a:b].tobytes() for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(packed, pa.binary())], names=["id", "label", "terms"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("id", "label", "text")
    got = rows.mapInArrow(run, f"id {kind}, label int, terms binary").groupBy("id", "label").agg(F.min("terms").alias("terms")).select("label", "terms").collect()
    got.sort(key=lambda r: (r[0], bytes(r[1])))
    label = np.array([r[0] for r in got], float)
    held = [np.frombuffer(r[1], np.int32) for r in got]
    n, place = len(label), np.full(BUCKETS, -1, np.int32)
    if not n or label.min() == label.max():
        mean = float(label.mean()) if n else 0.0
        return Machine(place, float(np.log((mean + 1e-9) / (1 - mean + 1e-9))), np.zeros(0), np.zeros((0, factors)))
    mixed_up = np.random.default_rng(0).permutation(n)  # so that halves of the rows hold both labels
    label, held = label[mixed_up], [held[k] for k in mixed_up]
    row, bucket = np.repeat(np.arange(n, dtype=np.int32), [len(h) for h in held]), np.concatenate(held)
    often = np.flatnonzero(np.bincount(bucket, minlength=BUCKETS) >= LEAST_ROWS)
    row, term = only(row, bucket, BUCKETS, often)
    far = standing_out(row, term, label, len(often))
    alone = np.argsort(-far, kind="stable")[:TERMS]
    alone = alone[far[alone] >= Z]
    rest = unexplained(n, row, term, label, len(often), alone, factors)
    kept = np.union1d(alone, paired(n, row, term, rest, len(often)))
    row, term = only(row, term, len(often), kept)
    place[often[kept]] = np.arange(len(kept))
    w0, w, v = fit_machine(n, row, term, label, len(kept), factors)
    return Machine(place, w0, w, v)


def scored(spark: SparkSession, machine: Machine, text: Column) -> Column:
    """The score from 0 to 1 of a column of whole texts; null and empty texts get the score of no terms."""
    sent = prepare(spark).sparkContext.broadcast(machine)

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], names=["text"])
            yield pd.Series(np.concatenate([np.zeros(0), *(sent.value.score(b.column(0)) for b in blocks(iter([batch])))]))

    return F.pandas_udf(scores, "double")(text.cast("string"))


def score(docs: DataFrame, machine: Machine, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """The rows with a score from 0 to 1 of the whole text. Null and empty texts get the score of no terms.

    Repeated rows and rows of any ids each get theirs; an empty table gives none; a column of the score's name is replaced.
    """
    return docs.withColumn(score_col, scored(docs.sparkSession, machine, F.col(text_col)))
