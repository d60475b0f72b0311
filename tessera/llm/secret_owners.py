"""Secrets in texts, judged by how many owners share them.

Candidates are assignments to telling names, access-key ids, hexadecimal runs and, beyond
these, long mixed tokens. Their values' hashes are counted over distinct owners and
repositories of the whole corpus. A value looks live if at most ``MOST_OWNERS`` owners and at most ``MOST_REPOS``
repositories have it; one that more owners have, or that one owner has pasted into many repositories, is a copied example. Long
mixed tokens are reported only when they look live; candidates of the three base kinds always are, with
the number of those that look live beside them.

An owner is a value of ``owner_col``. A repository is a value of ``repo_col`` or, without such a column, a distinct text of an
owner: copies of a document are one repository, however many there are.

Values that very many candidates have are broadcast with their judgement (``join_counted``).

Edge cases: null and empty texts have no span; a null owner or repository
counts as one of its own; repeated rows are reported each, and add no owner and no repository; an empty table
gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.joins import join_counted
from tessera.llm.text import slices
from tessera.operators.storage import materialize

#: Kinds in the order in which spans that begin together are listed.
KINDS = ("assign", "access", "hex", "owned")
#: Owners and repositories that a live-looking value has at most.
MOST_OWNERS, MOST_REPOS = 1, 3
#: Bits a character of a long mixed token has at least.
LEAST_ENTROPY = 3.5

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_MIXED = re.compile(r"[A-Za-z0-9_-]{24,}")
#: Texts without a match of these have no span of the kind; they run in linear time.
_MAY = (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}""", r"AKIA[A-Z0-9]{12}", r"[0-9a-f]{32}", r"[A-Za-z0-9_-]{24}")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the three base kinds, by start and kind."""
    found = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def _entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def mixed_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long tokens of letters and digits with high entropy that touch no span of ``taken``."""
    found = []
    for m in _MIXED.finditer(text):
        value, a, b = m[0], m.start(), m.end()
        mixed = re.search("[0-9]", value) and re.search("[A-Z]", value) and re.search("[a-z]", value)
        if mixed and _entropy(value) >= LEAST_ENTROPY and not any(s < b and a < e for s, _, e, _ in taken):
            found.append((a, 3, b, value))
    return found


def _joined(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str | None) -> DataFrame:
    """One row for each document, with counts and digest of its base spans and all candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.string())])
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                may = np.zeros(len(texts), bool)
                for pattern in _MAY:
                    may |= pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
                counts, digests, spans = np.zeros((3, len(texts)), np.int64), [nothing] * len(texts), [[]] * len(texts)
                for i in np.flatnonzero(may).tolist():
                    text = texts[i].as_py()
                    base = base_spans(text)
                    for _, kind, _, _ in base:
                        counts[kind, i] += 1
                    digests[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
                    spans[i] = [(a, k, b, hashlib.sha256(v.encode()).hexdigest()[:32]) for a, k, b, v in base + mixed_spans(text, base)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(2), rows.column(3), *map(pa.array, counts), pa.array(digests), pa.array(spans, pa.list_(span))],
                    ["id", "owner", "repo", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
                )

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(owner_col).cast("string").alias("owner"), (F.col(repo_col).cast("string") if repo_col else F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("repo"))
    return kept.mapInArrow(
        run,
        f"id {kept.schema['id'].dataType.simpleString()}, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start:long,kind:int,end:long,value:string>>",
    )


def ownership(found: DataFrame) -> DataFrame:
    """(value, owners, repos, n) of each candidate's hash; n: its occurrences."""
    seen = found.select(F.explode("found.value").alias("value"), F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repo", F.lit("\0")).alias("repo"))
    each = seen.groupBy("value", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = each.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("n"))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS
) -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied) of each row."""
    found = materialize(candidates(docs, id_col, text_col, owner_col, repo_col).withColumn("row", F.monotonically_increasing_id()), "candidates")
    live = (F.col("owners") <= most_owners) & (F.col("repos") <= most_repos)
    judged = materialize(ownership(found).withColumn("live", live), "owners")
    each = found.where(F.size("found") > 0).select("row", F.explode("found").alias("s")).withColumn("value", F.col("s.value"))
    told = join_counted(each, judged.select("value", "live", "n"), ["value"])
    kept = told.where("live or s.kind < 3")
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("s.kind") + 1)
    text = F.concat_ws(":", name, F.col("s.start"), F.col("s.end"))
    spans = kept.groupBy("row").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("s.start"), F.col("s.kind"), text.alias("t")))), lambda x: x["t"]), ",").alias("spans"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_copied"),
    )
    none = {"spans": "", "n_live": 0, "n_copied": 0}
    return found.join(spans, "row", "left").fillna(none).select(F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", *none)
