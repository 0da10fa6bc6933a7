"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns documents again (the last:
their ids), with doc_id, text, lang, source and n_chars; what runs it writes
each result as Parquet and hands the read-back table to the next stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import bpe, decontaminate, near_duplicates, quality, substrings
from tempora.tables import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Of the near-duplicate stage: words of a shingle, and the least similarity of a link in hundredths.
SHINGLE, SIMILARITY = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed limits or the outlier test reject go, null and empty texts among them; repeated rows are judged each."""
    return quality.judge(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one row stays, that of the smallest doc_id (a null one last); texts without words stay."""
    return near_duplicates.keep_one(docs.select(*COLUMNS), size=SHINGLE, num=SIMILARITY, den=100)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 35 words or more that stand elsewhere too go; a text that loses none stays as it is."""
    out = substrings.remove_repeats(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark windows go; repeated rows are judged each, null and empty texts stay."""
    found = decontaminate.find_items(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words"))).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids instead of the text, and whether these decode to it (null: to nothing); repeated rows are encoded each."""
    out = bpe.round_trip(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    whole = F.coalesce(F.col("text"), F.lit("")) == F.col("decoded").cast("string")
    return out.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", whole.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("decontamination", decontamination),
    ("byte bpe", byte_bpe),
]

#: SQL has neither the outlier test nor the merges; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
