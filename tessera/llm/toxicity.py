"""Toxicity by a linear classifier on character n-grams with naive Bayes ratios.

Features are the character n-grams of a text in lower case, hashed to a fixed table;
a feature counts once for a text. The log-count ratio r = log((p/|p|)/(q/|q|)) of a feature
in toxic (p) and other (q) texts scales it, and a logistic regression is fitted on
the scaled features (Wang and Manning, 2012). Features whose ratio is within its own
noise are left out.

The model is of bounded size: it learns from ``sample_rows`` texts for each class at most, chosen by hash, and has at most
``features`` features, those of the surest ratios that are at least ``least_z`` standard errors from zero and that at least
``least_texts`` texts have. Scoring reads every text whole, long ones in pieces of bounded size. Labels and ids are used to pick
training texts, never as inputs of a score.

Edge cases: null and empty texts have no feature and get the intercept's score;
labelled rows with a null id, a null label or no document teach nothing; an id with both labels counts as toxic, and
of several texts of one id the one with the least hash teaches; with no rows of
one of the classes every score is that of the other's share, smoothed; repeated
rows are scored alike; an empty table gives no rows. Only the id and the text
column are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import codepoints, slices
from tessera.operators.storage import materialize

ORDERS = (3, 4, 5, 6)
#: Bytes of text whose features are held at once.
SLICE = 1 << 20
#: Bits of the hash table of each order.
BITS = 20
#: Labelled texts of each class to learn from at most.
SAMPLE_ROWS = 3000
#: Features to fit at most.
FEATURES = 1 << 14
#: Least |r| in standard errors of r, and texts that have a feature at least.
LEAST_Z, LEAST_TEXTS = 3.0, 4
#: Characters of one text whose features are held at once.
PIECE = 1 << 20


def grams(points: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``order`` characters from each position, and whether they lie in one text."""
    n = max(0, len(points) - order + 1)
    h = np.zeros(n, np.uint32)
    for k in range(order):
        h *= np.uint32(0x01000193)
        h ^= points[k : k + n]
        h *= np.uint32(0x9E3779B1)
    inside = np.ones(n, bool)
    for k in range(1, order):  # the last order - 1 positions of each text
        ends = offsets[1:] - k
        ends = ends[(ends >= offsets[:-1]) & (ends < n)]
        inside[ends] = False
    return h >> np.uint32(32 - BITS), inside


def present(texts: pa.Array, code: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once, by text. ``code`` maps the table to features, -1: none."""
    points, offsets = codepoints(pc.utf8_lower(texts).cast(pa.large_string()))
    if len(texts) == 1 and len(points) > PIECE:
        return _present_in_one(points, code)
    keys = []
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(offsets))
    for i, order in enumerate(ORDERS):
        h, inside = grams(points, offsets, order)
        feature = h.astype(np.int64) | (i << BITS)
        if code is not None:
            feature = code[feature]
            inside &= feature >= 0
        at = np.flatnonzero(inside)
        keys.append(np.unique(doc[at] << 32 | feature[at]))
    every = np.sort(np.concatenate(keys))
    return every >> 32, every & 0xFFFFFFFF


def _present_in_one(points: np.ndarray, code: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """``present`` of one long text, piece by piece; pieces overlap, so that no feature is cut."""
    seen = np.zeros(len(ORDERS) << BITS if code is None else int(code.max()) + 2, bool)
    for at in range(0, len(points), PIECE):
        part = points[at : at + PIECE + max(ORDERS) - 1]
        for i, order in enumerate(ORDERS):
            feature = grams(part, np.array([0, len(part)]), order)[0].astype(np.int64) | (i << BITS)
            seen[feature if code is None else code[feature]] = True
    if code is not None:
        seen[-1] = False  # no feature of the model
    found = np.flatnonzero(seen)
    return np.zeros(len(found), np.int64), found


@dataclass
class Model:
    code: np.ndarray = field(repr=False)
    weight: np.ndarray = field(repr=False)
    intercept: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        doc, feature = present(texts, self.code)
        total = np.bincount(doc, self.weight[feature], len(texts)) if len(doc) else np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(total + self.intercept, -30, 30)))


def fit(doc: np.ndarray, feature: np.ndarray, ratio: np.ndarray, toxic: np.ndarray, l2: float = 0.02, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights of the unscaled features and the intercept; both classes weigh alike, however many texts they have."""
    n, w, b = len(toxic), np.zeros(len(ratio)), 0.0
    m, v, mb, vb = np.zeros(len(ratio)), np.zeros(len(ratio)), 0.0, 0.0
    row_weight = np.where(toxic == 1, 0.5 / max(1, (toxic == 1).sum()), 0.5 / max(1, (toxic == 0).sum()))
    cuts = np.searchsorted(doc, np.arange(0, n + 512, 512))
    for t in range(1, steps + 1):
        scaled, z, g = w * ratio, np.full(n, b), np.zeros(len(ratio))
        for at, to in zip(cuts, cuts[1:], strict=False):  # few temporary values at a time
            z += np.bincount(doc[at:to], scaled[feature[at:to]], n)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) * row_weight
        for at, to in zip(cuts, cuts[1:], strict=False):
            g += np.bincount(feature[at:to], error[doc[at:to]], len(ratio))
        g, gb = g * ratio + l2 * w / n, error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.05 * (1 - t / (steps + 1))
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w * ratio, b


def ratios(p: Column, q: Column, toxic: int, other: int) -> tuple[Column, Column]:
    """Log-count ratio of a feature that ``p`` of ``toxic`` texts and ``q`` of ``other`` ones have, and how many standard errors it is from zero."""
    ratio = F.log((p + 1) / (toxic + 2)) - F.log((q + 1) / (other + 2))
    return ratio, ratio / F.sqrt(1 / (p + 1) - 1 / (toxic + 2) + 1 / (q + 1) - 1 / (other + 2))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, least_z: float = LEAST_Z, least_texts: int = LEAST_TEXTS) -> Model:
    """A model from ``labels``, which holds the rows to learn from only."""
    spark = docs.sparkSession
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    totals = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    share = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    empty = Model(np.full(len(ORDERS) << BITS, -1, np.int32), np.zeros(1), float(np.log(share / (1 - share))))
    if len(totals) < 2:
        return empty
    chosen = [marked.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample_rows).toPandas() for y in (0, 1)]
    ids = spark.createDataFrame([(r.id, int(r.y)) for c in chosen for r in c.itertuples()], marked.schema)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id").select("id", "y", "text")
    one = F.min(F.struct(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text"))["text"]
    sample = materialize(found.groupBy("id", "y").agg(one.alias("text")), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, q = np.zeros(len(ORDERS) << BITS, np.int32), np.zeros(len(ORDERS) << BITS, np.int32)
        for batch in batches:
            for rows, texts in slices(batch, "text", SLICE):
                doc, feature = present(texts)
                y = rows.column(1).to_numpy()[doc]
                p += np.bincount(feature[y == 1], minlength=len(p)).astype(np.int32)
                q += np.bincount(feature[y == 0], minlength=len(q)).astype(np.int32)
        at = np.flatnonzero(p + q)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(p[at]), pa.array(q[at])], ["slot", "p", "q"])

    counts = sample.mapInArrow(count, "slot int, p int, q int").groupBy("slot").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).where(F.col("p") + F.col("q") >= least_texts)
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return empty
    np_, nq = sizes[1], sizes[0]
    ratio, z = ratios(F.col("p"), F.col("q"), np_, nq)
    best = counts.select("slot", ratio.alias("r"), F.abs(z).alias("z")).where(F.col("z") >= least_z).orderBy(F.desc("z"), "slot").limit(features).toPandas()
    if best.empty:
        return empty
    code = empty.code.copy()
    code[best["slot"].to_numpy()] = np.arange(len(best))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch, "text", SLICE):
                doc, feature = present(texts, code)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32()), pa.array(feature, pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), lists], ["id", "y", "features"])

    schema = sample.schema
    rows = sample.mapInArrow(pick, f"id {schema['id'].dataType.simpleString()}, y int, features array<int>").orderBy("id").toArrow()
    lists = rows["features"].combine_chunks()
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    weight, intercept = fit(doc, lists.flatten().to_numpy(), best["r"].to_numpy(), rows["y"].to_numpy())
    return Model(code, weight, intercept)


def with_score(docs: DataFrame, model: Model, score_col: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with the score of each row's text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.code, model.weight, model.intercept))

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Model(*shared.value)
        for values in batches:
            batch = pa.RecordBatch.from_arrays([values], ["text"])
            yield pa.array(np.concatenate([scorer.scores(texts) for _, texts in slices(batch, "text", SLICE)] or [np.zeros(0)]))

    return docs.withColumn(score_col, scored(F.col(text_col)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row."""
    return with_score(docs.select(id_col, text_col), model, "score", text_col).select(id_col, "score")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
