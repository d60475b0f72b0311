"""Claims from a stream of notes.

Extraction looks at one note at a time, so the same Columns run under Structured Streaming without state. Resolution is a
fixpoint over all records and stays a batch job over the claims that the stream has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.claims import emit
from tessera.sources.readers import note_parts


def note_claims(notes: DataFrame, id_col: str = "note_id", text_col: str = "text") -> DataFrame:
    """Claims of (id, text) rows, of a stream or a table."""
    rows = notes.where(F.col(text_col).isNotNull()).withColumn("entity_key", F.concat(F.lit("notes:"), F.col(id_col).cast("string"))).withColumn("record_seq", F.col(id_col).cast("long"))
    return emit(rows, "notes", "regex_extract", note_parts(F.col(text_col)))


def write_claims(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Read Parquet files of (note_id long, text string) as they arrive in ``folder`` and append their claims to ``out``."""
    notes = spark.readStream.schema("note_id long, text string").parquet(folder)
    return note_claims(notes).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
