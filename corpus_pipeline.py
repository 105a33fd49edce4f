"""From raw documents to packed training sequences: five stages, each reading all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geopanel.llm.common import cut
from geopanel.llm.line_dedup import drop_common_lines
from geopanel.llm.minhash import near_duplicates
from geopanel.llm.mixing import mix
from geopanel.llm.packing import pack
from geopanel.llm.quality import fit, score

#: Columns that every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KEEP_FROM = 0.3


def _training_fold(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out fifth of documents."""
    return labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores KEEP_FROM or more stay, as they are."""
    machine = fit(docs, _training_fold(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(docs, machine, keep=COLUMNS).where(F.col("score") >= KEEP_FROM).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from the texts; n_chars follows the new text; no document goes."""
    out = drop_common_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("lines_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates on five-word shingles stays, the one with the least id. Documents
    without words or without an id stay."""
    gone = near_duplicates(docs).where(~F.col("kept") & F.col("id").isNotNull()).select(F.col("id").alias("doc_id")).distinct()
    out = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    return out.select(*COLUMNS).dropDuplicates()


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target shares of 150% of all words; documents repeat or drop out accordingly."""
    return mix(docs.select(*COLUMNS), ordered=True).select(*COLUMNS)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids with their place in a sequence."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]

#: The classifier, the hashes and the packing plan are beyond SQL; tests hold each stage against the
#: operator it calls, and the operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each result written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
