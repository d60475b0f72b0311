"""Substring deduplication by content-defined chunks.

Every whole text is cut by a gear rolling hash into chunks of about 2**bits bytes. Cuts follow the content, so a passage is
cut alike wherever it stands. From each chunk on, as many chunks as come to ``least_run`` bytes are a passage; a passage
whose digest occurred in an earlier document, or earlier in its own, is a repeat. Repeats that overlap or touch form a run. So every run is made
of passages that really stand somewhere before, and of whole chunks: up to a chunk at either edge of a repeated passage is left out.

A task sorts the passages of a few megabytes of text before anything is moved, and sends each digest once, with its first place and a list of
all others there. So a passage that a third of all rows have costs a row for each of these slices, and its group is read as a
stream: only its first place is remembered.

Documents are ordered by id. Edge cases: null and empty texts have no chunk; rows equal in id and text count as one document, rows
that share an id but not the text are documents of their own, ordered by a hash of the text; null ids come after all others; a text without a cut, such as one
character repeated, is cut every ``MOST`` bytes; an empty table gives no rows. Only the id and the text column
are read. A worker needs memory in proportion to the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import gear
from tessera.llm.text import slices, utf8

#: log2 of the mean bytes of a chunk, and bytes at most.
BITS, MOST = 5, 192
#: Bytes of a passage, and so of a run, at least.
LEAST_RUN = 96
KEYS = ["nul", "id", "tie"]
FIRST = ["first_nul", "first_id", "first_tie", "first_start"]


def passages(raw: np.ndarray, offsets: np.ndarray, bits: int, least_run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the passage from each chunk on, where the text is long enough."""
    doc, starts, ends = gear.chunks(raw, offsets, bits, MOST)
    to = np.searchsorted(ends, starts + least_run)
    inside = to < len(ends)
    inside[inside] &= doc[to[inside]] == doc[inside]
    return doc[inside], starts[inside], ends[to[inside]]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    none = F.lit("").cast(kind) if kind == "string" else F.lit(0).cast(kind)
    return docs.select(F.col(id_col).isNull().alias("nul"), F.coalesce(F.col(id_col), none).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"), F.col(text_col).alias("text"))


def passage_table(docs: DataFrame, id_col: str, text_col: str, bits: int, least_run: int) -> DataFrame:
    """(d1, d2, nul, id, tie, start, length, more) of each digest and slice: its first place there, and the others."""
    kept = _keyed(docs, id_col, text_col)
    kind = kept.schema["id"].dataType.simpleString()
    place = f"struct<nul:boolean,id:{kind},tie:bigint,start:int,length:int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                raw, offsets = utf8(texts)
                doc, starts, ends = passages(raw, offsets, bits, least_run)
                view = memoryview(raw.tobytes())
                halves = np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), "<i8").reshape(-1, 2)
                keys = pa.Table.from_arrays([rows.column(i) for i in range(3)], KEYS)
                rank = np.empty(len(rows), np.int64)
                rank[pc.sort_indices(keys, [(k, "ascending") for k in KEYS]).to_numpy()] = np.arange(len(rows))
                order = np.lexsort((starts, rank[doc], halves[:, 1], halves[:, 0]))
                doc, starts, ends, halves = doc[order], starts[order], ends[order], halves[order]
                new = np.ones(len(doc), bool)
                new[1:] = (halves[1:] != halves[:-1]).any(axis=1)
                heads, others = np.flatnonzero(new), np.flatnonzero(~new)

                def at(index: np.ndarray, rows=rows, doc=doc, starts=starts, ends=ends, offsets=offsets) -> list[pa.Array]:
                    where = pa.array(doc[index])
                    return [*(rows.column(i).take(where) for i in range(3)), pa.array((starts - offsets[doc])[index], pa.int32()), pa.array((ends - starts)[index], pa.int32())]

                cuts = np.searchsorted(others, np.append(heads, len(doc)))
                more = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(at(others), [*KEYS, "start", "length"]))
                yield pa.RecordBatch.from_arrays([pa.array(halves[heads, 0]), pa.array(halves[heads, 1]), *at(heads), more], ["d1", "d2", *KEYS, "start", "length", "more"])

    return kept.mapInArrow(run, f"d1 long, d2 long, nul boolean, id {kind}, tie long, start int, length int, more array<{place}>")


def later_passages(table: DataFrame) -> DataFrame:
    """(nul, id, tie, start, length, first_nul, first_id) of every place but the first of each digest."""
    kind = table.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = first = None
        for batch in batches:
            if not len(batch):
                continue
            d = np.column_stack([batch.column(i).to_numpy() for i in (0, 1)])
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]).any(axis=1)
            place = batch.columns[2:6]
            if goes_on := last is not None and tuple(d[0]) == last:
                new[0] = False
                place = [pa.concat_arrays([f, c]) for f, c in zip(first, place, strict=True)]
            heads = np.maximum.accumulate(np.where(new, np.arange(len(d)) + goes_on, 0))
            last, first = tuple(d[-1]), [c.slice(int(heads[-1]), 1) for c in place]
            kept = np.flatnonzero(~new | (pc.list_value_length(batch.column(7)).to_numpy() > 0))
            rows, heads = batch.take(pa.array(kept)), pa.array(heads[kept])
            yield pa.RecordBatch.from_arrays([pa.array(~new[kept]), *rows.columns[2:], *(c.take(heads) for c in place)], ["later", *batch.schema.names[2:], *FIRST])

    place = [*KEYS, "start", "length"]
    schema = f"later boolean, nul boolean, id {kind}, tie long, start int, length int, more {table.schema['more'].dataType.simpleString()}, first_nul boolean, first_id {kind}, first_tie long, first_start int"
    sorted_ = table.repartition("d1", "d2").sortWithinPartitions("d1", "d2", *KEYS, "start")
    found = sorted_.mapInArrow(run, schema)
    own = F.struct(*place)
    listed = F.when(F.col("later"), F.concat(F.array(own), "more")).otherwise(F.col("more"))
    spread = found.select(*FIRST, F.explode(listed).alias("p")).select(*[f"p.{c}" for c in place], *FIRST)
    # rows equal in id and text are one document
    return spread.where(F.struct(*KEYS, "start") != F.struct(*FIRST)).select(*place, "first_nul", "first_id")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, least_run: int = LEAST_RUN) -> DataFrame:
    """(id_col, text_hash, start, length, first_id) of each run; start and length in UTF-8 bytes.

    ``first_id``: the first document that has the run's first passage. ``text_hash``: XXH64 of the text as Spark computes it.
    """
    later = later_passages(passage_table(docs, id_col, text_col, bits, least_run)).distinct()
    of_text = Window.partitionBy(*KEYS).orderBy("start")
    end = F.col("start") + F.col("length")
    so_far = F.max(end).over(of_text.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("start") > so_far, F.lit(True)).cast("long")
    runs = later.withColumn("opens", opens).withColumn("run", F.sum("opens").over(of_text.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*KEYS, "run")
    first = F.min_by(F.when(~F.col("first_nul"), F.col("first_id")), "start")
    runs = runs.agg(F.min("start").alias("start"), F.max(end).alias("end"), first.alias("first_id"))
    return runs.select(F.when(~F.col("nul"), F.col("id")).alias(id_col), F.col("tie").alias("text_hash"), "start", (F.col("end") - F.col("start")).alias("length"), "first_id")


def without_repeats(docs: DataFrame, runs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the bytes of ``runs`` taken out of their texts; a character cut in two goes whole."""
    spans = runs.groupBy(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash")).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("_spans"))
    same = docs[id_col].eqNullSafe(spans["_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == spans["_hash"])
    joined = docs.join(spans, same, "left").drop("_id", "_hash")

    @F.pandas_udf("string")
    def cut(text, spans):
        def one(value, found):
            if value is None or found is None:
                return value
            raw, out, at = value.encode(), [], 0
            for s in found:
                out.append(raw[at : s["start"]])
                at = s["start"] + s["length"]
            return b"".join([*out, raw[at:]]).decode("utf-8", "ignore")

        return text.combine(spans, one)

    return joined.withColumn(text_col, cut(F.col(text_col), F.col("_spans"))).select(docs.columns)
