"""A corpus pipeline: toxicity, near-duplicates, benchmark leaks, personal data, byte-level BPE.

Each stage works on all rows its predecessor kept.  All but the last return the columns of
documents.  Null, empty and blank texts pass every filter: they have nothing to go by.  Rows
are told apart by key and text, so rows with one key (null among them) and different texts
are judged each by its own text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.byte_bpe import bpe_round_trip
from pathloom.llm.common import table, written
from pathloom.llm.decontaminate import contaminated
from pathloom.llm.pii import mask_pii
from pathloom.llm.simhash import has_words, near_duplicate_groups, text_mark
from pathloom.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: the one with the smallest key."""
    groups = near_duplicate_groups(docs)
    kept = groups.filter(F.col("id").eqNullSafe(F.col("group_id")) & (F.col("mark") == F.col("group_mark"))).select("id", "mark").distinct()
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_mark(F.col("text")).alias("mark"), has_words(F.col("text")).alias("worded"))
    same = kept["id"].eqNullSafe(marked["id"]) & (kept["mark"] == marked["mark"])
    left = marked.filter("worded").join(kept, same, "left_semi").dropDuplicates(["id", "mark"])
    return left.unionByName(marked.filter("not worded")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go; a row with the same key and another text stays."""
    marked = docs.select(F.struct("*").alias("row"), F.concat_ws(":", "doc_id", F.md5("text")).alias("mark"))
    leaks = written(contaminated(marked.select("mark", "row.text"), table(spark, sf_dir, "benchmark"), id_col="mark").select("mark").distinct(), "leaks")
    return marked.join(leaks, "mark", "left_anti").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts; ``n_chars`` follows."""
    return mask_pii(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, decoded again to prove the round trip."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe_round_trip(docs, ranks, pattern)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
