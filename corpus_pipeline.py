"""Corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing; each stage is written and read again.

Every stage takes rows with a doc_id and a text, whatever their other columns and names, and all but the last give back these
columns, of the rows that they keep. Empty tables give empty tables; texts of any length are read whole.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kryptonym.llm import decontam, linededup, neardup, packing, toxicity
from kryptonym.llm.common import checkpoint_dir, checkpointed, prepare, table, without


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores under 0.5. It learns from the labels of the whole table.

    Null and empty texts get the score of no terms; repeated rows and rows of equal score fare alike; a null id is an id like any
    other. No column is added, so none can clash.
    """
    prepare(spark)
    machine = toxicity.fit(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scored(spark, machine, F.col("text")) < 0.5)


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that three or more documents share, but in the last of them; n_chars, if there, follows the text.

    All rows stay. A null text is one empty line and becomes empty; repeated rows count as documents; of equal ids all keep
    the line; a null id comes before any other. Columns n_lines and n_dropped of the input stay as they are.
    """
    prepare(spark)
    out = linededup.dedup_lines(docs, counted=False)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class of near-duplicates (five-word shingles, Jaccard 0.8).

    Candidates are found by bit-sliced SimHash distances. Null and empty texts are one class; all rows of the id that stays
    do; a row without an id stays.
    """
    prepare(spark)
    gone = neardup.near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return without(docs, checkpointed(gone), "doc_id").select(docs.columns)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item.

    Each row is judged by its own text: null and empty texts stay, so do null ids and repeated rows that hold nothing.
    """
    prepare(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' token ids in windows of 4096.

    Null and empty texts are one token; repeated rows and rows without an id are packed each; of equally good windows the first is
    taken. Other columns than doc_id and text are left behind.
    """
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", stage_toxicity),
    ("line dedup", stage_line_dedup),
    ("near-dedup", stage_near_dedup),
    ("decontamination", stage_decontamination),
    ("packing", stage_packing),
]

#: A trained score, hash links and token ids can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The stages one after the other over documents, through Parquet in a shared folder.

    With a folder of its own a run that died goes on behind its last whole stage. What a stage read is removed once its
    own rows are written.
    """
    docs = table(spark, sf_dir, "documents")
    folder = folder or f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    files = path_of(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    done = [k for k in range(len(STAGES)) if files.exists(path_of(f"{folder}/{k}/_SUCCESS"))]
    if done:
        docs = spark.read.parquet(f"{folder}/{done[-1]}")
    for k, (_, stage) in enumerate(STAGES):
        if done and k <= done[-1]:
            continue
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            files.delete(path_of(f"{folder}/{k - 1}"), True)
    return docs
