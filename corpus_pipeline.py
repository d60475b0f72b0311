"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before it kept. All but the last return the columns of
``documents``. Null texts count as empty; rows without any label teach the classifier nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_winnow, mixing, packing, simhash_similar, toxicity
from tessera.llm.queries import vocabulary
from tessera.operators.storage import materialize

#: Share of the tokens that reach the mixing stage which it hands on.
MIX_SHARE = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic. Rows with equal id and text share their fate."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    return toxicity.with_score(docs, model, "_tox_score").where("_tox_score < 0.5").drop("_tox_score")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated runs of lines; those of which nothing is left go."""
    kept = line_winnow.deduplicated(docs)
    gone = (F.col("_w_n_deleted") > 0) & (F.trim("text") == "")
    kept = kept.where(~gone).withColumn("n_chars", F.when(F.col("_w_n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of texts whose five-word shingles are alike to 0.8 or more; rows without an id stay."""
    groups = simhash_similar.near_duplicates(docs)
    copies = groups.where("doc_id <> component_id").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the budget of their source takes, each once."""
    taken = mixing.select_rows(docs, share=MIX_SHARE, epochs=1).select(F.col("doc_id").alias("_mix_id")).distinct()
    return docs.join(taken, F.col("doc_id").eqNullSafe(F.col("_mix_id")), "left_semi").select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Classifier, XXH64 and tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
