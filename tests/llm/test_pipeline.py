"""The pipeline, stage by stage, against plain versions of the operators."""

from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from test_jaccard import brute as jaccard_brute
from test_lines import brute as lines_brute

import corpus_pipeline as pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tickloom import session


def table(df):
    return [tuple(r) for r in df.select(pipeline.COLUMNS).collect()]


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "mixing", "encoding"]
    kept = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "encoding":
            assert out.columns == pipeline.COLUMNS
        path = str(tmp_path / name)
        out.write.parquet(path)
        kept[name] = spark.read.parquet(path)
        docs = kept[name]
    before = table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    told = table(kept["language_id"])
    assert set(told) <= set(before) and len(told) >= 0.99 * sum(1 for r in before if r[1] and any(c.isalpha() for c in r[1]))

    deduped = {r[0]: r[1] for r in table(kept["line_dedup"])}
    want = {i: t for i, t, n, left in lines_brute([(r[0], r[1]) for r in told]) if left or not n}
    assert deduped == want

    single = {r[0] for r in table(kept["jaccard_join"])}
    assert single == {i for _, i, _, c in jaccard_brute(list(deduped.items())) if c == i}

    mix = table(kept["mixing"])
    assert {r[0] for r in mix} <= single
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pipeline.PIECES))
    rows = kept["encoding"].collect()
    texts = {r[0]: r[1] for r in mix}
    assert len(rows) == len(mix)
    for r in rows[:200]:
        ids = library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_run_and_empty_table(spark, sf_dir):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
    assert pipeline.run(spark, sf_dir).count() > 0


def test_stages_send_workers_few_bytes_at_a_time(spark):
    """10 000 long texts at a time took some hundred MB of a worker and of its JVM."""
    docs = spark.range(3000, numPartitions=1).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 500).alias("text"), F.lit("en").alias("lang"),
        F.lit("web").alias("source"), F.lit(5500).cast("long").alias("n_chars"),
    )

    @F.arrow_udf("long")
    def sizes(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([batch.nbytes] * len(batch))

    def most():
        return docs.select(sizes("text").alias("n")).agg(F.max("n")).first()[0]

    for _, stage in pipeline.STAGES:
        spark.conf.unset(session._BATCH_SETTING)
        assert most() > 2 * session.BATCH_BYTES
        stage(spark, docs.limit(0), "")
        assert most() < 2 * session.BATCH_BYTES
    spark.conf.set(session._BATCH_SETTING, 1 << 20)  # a bound of the session's own stays
    pipeline.encoded(spark, docs, "")
    assert most() < 2 << 20
    spark.conf.unset(session._BATCH_SETTING)
