"""Mixing sources to target weights by hierarchical budgeting.

Documents are the leaves' contents of a tree of levels, such as domain, language and source. A
budget of tokens goes from the root to the leaves: a node's budget is shared among its
children by weight, and what a child cannot use (its documents' tokens times ``epochs``) is
shared among its siblings by weight. A node never gets more than it can use, so that a
shortage reaches the siblings of an ancestor only once all below the ancestor is used up. A leaf takes
whole epochs of its documents, then the prefix of a seeded order of the next epoch that fits
in the rest of its budget.

A leaf's order is cut into ``BUCKETS`` ranges of the hash, so that a leaf with a third of all
rows is summed by ranges in parallel, and no task sorts a whole leaf.

Edge cases: null levels count as the empty name, null weights' names weigh 1, a weight of 0
takes nothing; null and empty texts have no tokens and ride along where the prefix reaches them; rows
that tie in the seeded order are taken or left together; an empty table gives no rows. Columns
that are not named are carried through ``select_rows`` untouched; its own columns begin with ``mix_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.storage import materialize

#: Words are runs of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the seeded hash that make a range: 16 ** 3 ranges in a leaf.
RANGE_DIGITS = 3

LEVELS = ("domain", "lang", "source")
#: Weight of each name by level; others weigh 1.
WEIGHTS = {"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 4, "de": 2, "fr": 2}, "source": {"src0": 3}}
DOMAINS = ("web", "books", "code")
SEED = "mix-1"


def domain_of(source: Column) -> Column:
    """The domain of a source by the number at the end of its name; sources without one are web."""
    number = F.coalesce(F.nullif(F.regexp_extract(source, "[0-9]{1,9}$", 0), F.lit("")).cast("long"), F.lit(0))
    return F.element_at(F.array(*map(F.lit, DOMAINS)), (number % len(DOMAINS) + 1).cast("int"))


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    known = weights.get(level, {})
    found = F.lit(1)
    for name, weight in known.items():
        found = F.when(F.col(level) == name, F.lit(weight)).otherwise(found)
    return found.cast("decimal(18,0)")


def quotas(leaves: DataFrame, levels: tuple[str, ...], weights: dict[str, dict[str, int]], budget: int, epochs: int) -> DataFrame:
    """``leaves`` (levels, tokens) with ``quota``: the tokens that each is to give."""
    tree = leaves.withColumn("cap", (F.col("tokens") * epochs).cast("decimal(19,0)")).withColumn("budget", F.lit(budget).cast("decimal(19,0)"))
    for depth, level in enumerate(levels):
        path = list(levels[: depth + 1])
        nodes = tree.groupBy(*path).agg(F.sum("cap").cast("decimal(19,0)").alias("cap"), F.first("budget").alias("budget")).withColumn("w", _weight(level, weights))
        nodes = nodes.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0)).cast("decimal(19,0)"))
        ratio = F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w").cast("double")).otherwise(F.lit(0.0))
        siblings = Window.partitionBy(*path[:-1]) if depth else Window.partitionBy(F.lit(0))
        order = siblings.orderBy(ratio, level)
        before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
        nodes = nodes.withColumn("below", F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("decimal(19,0)")).withColumn("wsum", F.sum("w").over(rest).cast("decimal(18,0)"))
        full = (F.col("cap") * F.col("wsum") <= (F.col("budget") - F.col("below")).cast("decimal(19,0)") * F.col("w")).alias("full")
        nodes = nodes.withColumn("full", full)
        used = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(F.lit(0))).over(siblings).cast("decimal(19,0)")
        open_w = F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("w"))).over(siblings).cast("decimal(18,0)")
        nodes = nodes.withColumn("used", used).withColumn("open_w", open_w)
        share = F.expr("cast((w * cast(budget - used as decimal(19,0))) div open_w as decimal(19,0))")
        given = nodes.select(*path, F.when(F.col("full"), F.col("cap")).otherwise(share).alias("given"))
        tree = tree.join(given, path).drop("budget").withColumnRenamed("given", "budget")
    return tree.select(*levels, "tokens", F.col("budget").cast("long").alias("quota"))


def select_rows(docs: DataFrame, share: float = 0.5, epochs: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", weights: dict[str, dict[str, int]] | None = None, seed: str = SEED) -> DataFrame:
    """(id_col, domain, lang, source, n_tokens, epochs) of each row that is taken at least once.

    The budget is ``share`` of all tokens.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"))
    base = base.withColumn("domain", domain_of(F.col("source")))
    base = materialize(base, "tokens")
    leaves = materialize(base.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    budget = int(total * share)
    given = quotas(leaves, LEVELS, WEIGHTS if weights is None else weights, budget, epochs).select(*LEVELS, F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(F.lit(0)).alias("whole"), F.when(F.col("tokens") > 0, F.expr("quota % tokens")).otherwise(F.lit(0)).alias("rest"))
    leaf = [*LEVELS, "range"]
    rows = base.join(F.broadcast(given) if leaves.count() <= 10_000 else given, list(LEVELS))
    rows = rows.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.col("whole"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    sums = rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("n"))
    earlier = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    within = F.sum("n_tokens").over(Window.partitionBy(*leaf).orderBy("key"))
    taken = rows.join(sums, leaf).withColumn("epochs", F.col("whole") + (F.col("before") + within <= F.col("rest")).cast("long"))
    return taken.where("epochs > 0").select(F.col("id").alias(id_col), *LEVELS, "n_tokens", "epochs")


#: The same rows in DuckDB.
SQL = """
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
         ['web', 'books', 'code'][1 + coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '[0-9]{1,9}$'), '') AS BIGINT), 0) % 3] AS domain
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens FROM d GROUP BY ALL),
total AS (SELECT floor(sum(tokens)::DOUBLE * 0.5)::HUGEINT AS budget FROM leaves),
n1 AS (SELECT domain, sum(tokens) * 2 AS cap, (SELECT budget FROM total) AS budget,
         CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 WHEN 'code' THEN 2 ELSE 1 END AS w FROM leaves GROUP BY domain),
o1 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(w) OVER (ORDER BY cap::DOUBLE / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wsum FROM n1),
f1 AS (SELECT *, cap * wsum <= (budget - below) * w AS is_full FROM o1),
b1 AS (SELECT domain, CASE WHEN is_full THEN cap ELSE (w * (budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())) // (sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ()) END AS budget FROM f1),
n2 AS (SELECT domain, lang, sum(tokens) * 2 AS cap, any_value(budget) AS budget,
         CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w FROM leaves JOIN b1 USING (domain) GROUP BY domain, lang),
o2 AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap::DOUBLE / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(w) OVER (PARTITION BY domain ORDER BY cap::DOUBLE / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wsum FROM n2),
f2 AS (SELECT *, cap * wsum <= (budget - below) * w AS is_full FROM o2),
b2 AS (SELECT domain, lang, CASE WHEN is_full THEN cap ELSE (w * (budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY domain))) // (sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY domain)) END AS budget FROM f2),
n3 AS (SELECT domain, lang, source, tokens, tokens * 2 AS cap, budget, CASE source WHEN 'src0' THEN 3 ELSE 1 END AS w FROM leaves JOIN b2 USING (domain, lang)),
o3 AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(w) OVER (PARTITION BY domain, lang ORDER BY cap::DOUBLE / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wsum FROM n3),
f3 AS (SELECT *, cap * wsum <= (budget - below) * w AS is_full FROM o3),
b3 AS (SELECT domain, lang, source, tokens, CASE WHEN is_full THEN cap ELSE (w * (budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY domain, lang))) // (sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY domain, lang)) END AS quota FROM f3),
g AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN (quota // tokens)::BIGINT ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN (quota % tokens)::BIGINT ELSE 0 END AS rest FROM b3),
k AS (SELECT d.*, whole, rest, md5('mix-1:' || whole || ':' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM d JOIN g USING (domain, lang, source)),
s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto FROM k)
SELECT doc_id, domain, lang, source, n_tokens, whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS epochs
FROM s WHERE whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0
"""
