"""One query for each operator, over its whole table, with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import chat, convrepair, htmltext, jaccard, langid, licenses, lines, mixing, phrases, pieces, spotsigs, topk, urls

PIECES = "piece_bpe_32k.model"
RULES = [
    urls.Rule("allow", "com/"), urls.Rule("block", "example.com/en/"), urls.Rule("allow", "www.example.com/en/"),
    urls.Rule("block", "net/es/"), urls.Rule("block", "net/fr/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.train(docs.filter(~held_out), public_tokenizers.path(PIECES))
    rows = langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return rows.select("doc_id", "held_out", "lang_pred", "score")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known(spark, licenses.LICENSES | licenses.NOTICES))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"))


def op3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_counts(table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), RULES)


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_kept", F.sha2("text", 256).alias("kept_sha256"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))
    return rows.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.rotate(table(spark, sf_dir, "conversations"))
    return rows.withColumn("segment_sha256", F.sha2("segment", 256)).drop("segment")


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spotsigs.edited_pairs(table(spark, sf_dir, "documents"))
    return rows.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = htmltext.extract(table(spark, sf_dir, "pages"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mined(table(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convrepair.audits(table(spark, sf_dir, "conversations")).drop("roles")


def op10_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.near_pairs(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_langid": op1_langid,
    "op2_licenses": op2_licenses,
    "op3_jaccard": op3_jaccard,
    "op3_links": op3_links,
    "op4_topk": op4_topk,
    "op5_urls": op5_urls,
    "op6_lines": op6_lines,
    "op7_pieces": op7_pieces,
    "op8_chat": op8_chat,
    "op9_mixing": op9_mixing,
    "op10_spotsigs": op10_spotsigs,
    "op10_pairs": op10_pairs,
    "op11_html": op11_html,
    "op12_phrases": op12_phrases,
    "op13_repair": op13_repair,
}
SQL = {
    "op2_licenses": licenses.sql(licenses.LICENSES),
    "op4_topk": topk.SQL,
    "op6_lines": lines.SQL,
    "op8_chat": chat.SQL,
    "op9_mixing": mixing.SQL,
    "op10_spotsigs": spotsigs.SQL,
    "op10_pairs": spotsigs.PAIRS_SQL,
    "op12_phrases": phrases.SQL,
    "op13_repair": convrepair.SQL,
}
