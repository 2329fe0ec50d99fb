"""From documents to ids: a pipeline of operators for training data, each stage a table that the next one reads."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import jaccard, langid, lines, mixing, pieces
from tickloom.session import bound_batches, scratch_path, ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PIECES = "piece_bpe_32k.model"

# A document whose language is less sure than this is rejected.
SURE = 0.5


def _prepared(spark: SparkSession) -> None:
    """Executors keep their workers from stage to stage, so each stage keeps what they hold at a time small."""
    ship_package(spark)
    bound_batches(spark)


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; those without letters, or of no language for sure, go."""
    _prepared(spark)
    model = langid.train(docs, public_tokenizers.path(PIECES))
    rows = langid.predict(docs.select(COLUMNS), model)
    return rows.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= SURE)).select(COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that came before are taken out of the texts; documents of such lines only go."""
    _prepared(spark)
    rows = lines.dedup(docs.select(COLUMNS)).filter("n_kept > 0 or n_lines = 0")
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id stays of each group of similar ones."""
    _prepared(spark)
    kept = jaccard.groups(docs).filter("component_id = doc_id or doc_id is null").select("doc_id").distinct()
    match = docs["doc_id"].eqNullSafe(F.col("kept.doc_id"))
    return docs.join(kept.alias("kept"), match, "left_semi").select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the shares of their weights; a document may be taken several times or not at all."""
    _prepared(spark)
    return mixing.repeated(docs.select(COLUMNS))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and the text decoded from them."""
    _prepared(spark)
    return pieces.round_trip(docs, public_tokenizers.path(PIECES))


STAGES = [
    ("language_id", identified),
    ("line_dedup", without_repeated_lines),
    ("jaccard_join", one_of_each_group),
    ("mixing", mixed),
    ("encoding", encoded),
]

# Language ID and encoding cannot be expressed in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
