"""Searches over streams: the same plans, fed by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_html
from ..operators.search import term_hits


def text_stream(spark: SparkSession, path: str, schema: str, id_col: str, html_col: str) -> DataFrame:
    """New Parquet files of a folder as cleaned texts."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.select(F.col(id_col).cast("string").alias("entity_id"), F.lit(html_col).alias("field"), clean_html(F.col(html_col)).alias("text"))


def stream_hits(texts: DataFrame, terms: list[str], out: str, checkpoint: str):
    """Append hits to ``out`` until the folder's present files are read; a restart goes on from ``checkpoint``."""
    return term_hits(texts, terms).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
