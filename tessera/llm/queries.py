"""The queries of this package, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import brown_lm, chunk_dedup, edit_embed, line_winnow, media_chunks, mixing, packing, secret_owners, simhash_bk, toxicity


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The file of a public tokenizer, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score(_documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.near_duplicates(_documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select_rows(_documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), vocabulary())


def op5_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embed.fingerprints(_documents(spark, sf_dir))


def op6_line_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_winnow.deduplicated(_documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", F.col("_w_n_lines").alias("n_lines"), F.col("_w_n_deleted").cast("long").alias("n_deleted"), F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeats(_documents(spark, sf_dir))


def op8_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_owners.scan(_documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.media(_documents(spark, sf_dir))


QUERIES = {
    "op1_brown_lm": op1_brown_lm,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_packing": op4_packing,
    "op5_edit_embedding": op5_edit_embedding,
    "op6_line_winnow": op6_line_winnow,
    "op7_chunk_dedup": op7_chunk_dedup,
    "op8_secret_owners": op8_secret_owners,
    "op9_toxicity": op9_toxicity,
    "op10_media_chunks": op10_media_chunks,
}
ORACLES = {"op3_mixing": mixing.SQL, "op6_line_winnow": line_winnow.SQL}
