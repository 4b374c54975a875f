"""Masking of streams: records are independent, so the row scope runs on them as on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kryptonym.functions.columns import inner
from kryptonym.operators.mask import masked_column
from kryptonym.operators.masker import Config


def mask_stream(stream: DataFrame, text_col: str = "text", config: Config | None = None) -> DataFrame:
    """The stream with text_masked and keys; stateless, so any output mode but complete works."""
    name = inner(stream, "_m")[0]
    made = stream.withColumn(name, masked_column(F.col(text_col), config))
    return made.select(*stream.columns, F.col(name)["text"].alias("text_masked"), F.col(name)["keys"].alias("keys"))


def start(stream: DataFrame, out_path: str, checkpoint: str, text_col: str = "text", config: Config | None = None) -> StreamingQuery:
    """Masked rows to Parquet, without the raw text; each input row once, by the checkpoint."""
    made = mask_stream(stream, text_col, config).drop(text_col)
    return made.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append").start()


def counters(stream: DataFrame, time_col: str, window: str = "1 minute", late: str = "5 minutes", text_col: str = "text", config: Config | None = None) -> DataFrame:
    """Requests, characters and masks in each time window; late rows count until the watermark has passed."""
    name = inner(stream, "_m")[0]
    made = stream.withWatermark(time_col, late).withColumn(name, masked_column(F.col(text_col), config))
    return made.groupBy(F.window(time_col, window).alias("at")).agg(F.count("*").alias("requests"), F.sum(F.length(text_col)).alias("chars"), F.sum(F.size(F.col(name)["keys"])).alias("masks"))
