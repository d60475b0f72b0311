"""Line deduplication by winnowing over line hashes, in DataFrame functions only.

A text is the sequence of its lines that are not blank. A window is the shortest run of lines from a
line on, or back from it, that has ``least_chars`` characters. The least line hash of each
window is selected; with the digest of the lines before and after it up to both ends of the window
it is a fingerprint, so that a common line in a window cannot lead astray. Positions of equal
fingerprints are joined with the first of them: the match extends from the selected line both ways to the
ends of the window, windows that overlap become one run, and every later run is deleted.

What is found is exact: a line is deleted if and only if it lies in a run of lines with ``least_chars``
characters in all that also begins at an earlier place, in an earlier text or earlier in its own. Every line of such a run
lies in a window that is wholly inside the run. A window has at most ``least_chars`` lines, as no
line in it is empty; digests of 1, 2, 4, ... lines make its digest in few steps, so that the work is
linear in the lines of a text however they repeat. Texts of more than ``BLOCK_LINES`` lines are worked on in blocks.

Order is that of ids, then positions. A run is compared with its first place only, so a
group of n copies costs n matches. Fingerprints that very many texts have are broadcast (``join_counted``).

Blank lines (nothing but spaces) are not compared and go with the line before them. Line ends are
line feeds. Edge cases: null and empty texts have one empty line and lose nothing; rows equal in id
and text count as one document; rows that share an id with other texts are ordered by a hash of
the text; null ids come last; ids may have any type that has an order; an empty table gives no rows. Other columns are
carried through; names that begin with ``_w_`` are used within.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.joins import join_counted
from tessera.operators.storage import materialize

#: Characters of a run that is deleted at least.
LEAST_CHARS = 100
#: Lines of a block of a very long text.
BLOCK_LINES = 4096

KEYS = ["_w_null", "_w_id", "_w_tie"]
FINGERPRINT = ["h", "d", "g"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with a key that has no null: rows equal in id and text share it."""
    kind = docs.schema[id_col].dataType.simpleString()
    none = F.lit("").cast(kind) if kind == "string" else F.lit(0).cast(kind)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"_w_null": F.col(id_col).isNull(), "_w_id": F.coalesce(F.col(id_col), none), "_w_tie": F.xxhash64(text)})


def _lines(text_col: str) -> Column:
    return F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)


def _blocks(docs: DataFrame, id_col: str, text_col: str, reach: int, block_lines: int) -> DataFrame:
    """(keys, lead, own, total, lines): blocks of the lines that are not blank, with ``reach`` more at both ends.

    lines: (i, x), the line's number in the text and itself; ``lead`` lines belong to the block before, ``own`` to this one.
    """
    numbered = F.transform(_lines(text_col), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    filled = _keyed(docs, id_col, text_col).select(*KEYS, F.size(_lines(text_col)).alias("total"), F.filter(numbered, lambda s: F.trim(s["x"]) != "").alias("lines")).where(F.size("lines") > 0)
    spread = filled.withColumn("b", F.explode(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / block_lines).cast("int"))))
    at = F.col("b") * block_lines
    begin = F.greatest(at - reach, F.lit(0))
    return spread.select(*KEYS, (at - begin).alias("lead"), F.least(F.lit(block_lines), F.size("lines") - at).alias("own"), "total", F.slice("lines", begin + 1, at - begin + block_lines + reach).alias("lines"))


def _digest(x: Column, y: Column, p: Column, q: Column, n: Column | None = None) -> tuple[Column, Column]:
    """128 bits of two digests of 128 bits: two hashes from seeds of their own."""
    size = [] if n is None else [n]
    return F.xxhash64(*size, x, y, p, q).alias("d"), F.xxhash64(F.lit("second"), *size, x, y, p, q).alias("g")


def _doubled(below: Column, half: int):
    """From what is known of ``half`` lines to twice as many, null where the block ends before."""

    def joined(x: Column, i: Column) -> Column:
        y = F.get(below, i + half)
        return F.struct(x["i"].alias("i"), *_digest(x["d"], y["d"], x["g"], y["g"]), F.least(x["m"], y["m"]).alias("m"), (x["n"] + y["n"]).alias("n"))

    return joined


def _stepped(level: Column, width: int, sign: int):
    """One step over ``width`` lines where these have fewer characters than are needed."""

    def step(s: Column) -> Column:
        n = F.get(level, s["p"] if sign > 0 else s["p"] - width + 1)["n"]
        over = n < s["r"]
        return F.struct(s["a"].alias("a"), F.when(over, s["p"] + sign * width).otherwise(s["p"]).alias("p"), F.when(over, s["r"] - n).otherwise(s["r"]).alias("r"))

    return step


def windows(docs: DataFrame, id_col: str, text_col: str, least_chars: int, block_lines: int = BLOCK_LINES) -> DataFrame:
    """(keys, h, d, g, start, last): each window's least line hash, its digest of 128 bits, and its lines in the text.

    ``last`` takes in the blank lines that follow.
    """
    levels = max(1, least_chars.bit_length())
    rows = _blocks(docs, id_col, text_col, least_chars, block_lines)
    rows = rows.withColumn("a0", F.transform("lines", lambda s: F.struct(s["i"].alias("i"), F.xxhash64(s["x"]).alias("d"), F.xxhash64(F.lit("second"), s["x"]).alias("g"), F.xxhash64(s["x"]).alias("m"), F.length(s["x"]).alias("n"))))
    rows = rows.drop("lines")
    for j in range(1, levels):
        below = F.col(f"a{j - 1}")
        short = F.exists(below, lambda x: x["n"] < least_chars)
        rows = rows.withColumn(f"a{j}", F.when(short, F.transform(below, _doubled(below, 1 << (j - 1)))).otherwise(F.slice(below, 1, 0)))

    def walk(sign: int) -> Column:
        """(a, p, r) of each own line that reaches ``least_chars``: from line a to line p, of which r characters are needed."""
        steps = F.transform(F.sequence(F.col("lead"), F.col("lead") + F.col("own") - 1), lambda a: F.struct(a.alias("a"), a.alias("p"), F.lit(least_chars).alias("r")))
        for j in reversed(range(levels)):
            steps = F.transform(steps, _stepped(F.col(f"a{j}"), 1 << j, sign))
        return F.filter(steps, lambda s: F.get(F.col("a0"), s["p"])["n"] >= s["r"])

    rows = rows.withColumn("ahead", walk(1)).withColumn("back", walk(-1))
    # a window that both walks find is listed once
    found = F.concat(F.transform("ahead", lambda s: s["a"].cast("long") * (1 << 32) + s["p"]), F.transform("back", lambda s: s["p"].cast("long") * (1 << 32) + s["a"]))
    rows = rows.withColumn("found", F.array_distinct(found))

    def described(w: Column) -> Column:
        s, e = F.shiftright(w, 32).cast("int"), w.bitwiseAND(0xFFFFFFFF).cast("int")
        n = e - s + 1
        one = F.get(F.col("a0"), s)
        h, d, g = (F.when(n == 1, one[c]) for c in ("m", "d", "g"))
        for j in range(1, levels):
            x, y, fits = F.get(F.col(f"a{j}"), s), F.get(F.col(f"a{j}"), e - (1 << j) + 1), n < 2 << j
            joined = _digest(x["d"], y["d"], x["g"], y["g"], n)
            h, d, g = h.when(fits, F.least(x["m"], y["m"])), d.when(fits, joined[0]), g.when(fits, joined[1])
        last = F.coalesce(F.get(F.col("a0"), e + 1)["i"], F.col("total")) - 1
        return F.struct(h.alias("h"), d.alias("d"), g.alias("g"), one["i"].alias("start"), last.alias("last"))

    return rows.select(*KEYS, F.explode(F.transform("found", described)).alias("w")).select(*KEYS, "w.h", "w.d", "w.g", "w.start", "w.last")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, block_lines: int = BLOCK_LINES) -> DataFrame:
    """(keys, _w_kept, _w_tail) of each text that has later runs: the (from, to) lines before each run, and the first line after the last."""
    found = materialize(windows(docs, id_col, text_col, least_chars, block_lines), "windows")
    place = F.struct(*KEYS, "start")
    firsts = materialize(found.groupBy(*FINGERPRINT).agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1"), "firsts")
    matched = join_counted(found, firsts, FINGERPRINT)
    later = matched.where(place > F.col("f")).select(*KEYS, "start", "last")
    of_text = Window.partitionBy(*KEYS)
    so_far = F.max("last").over(of_text.orderBy("start", "last").rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("start") > so_far, F.lit(True)).cast("long")
    runs = later.withColumn("opens", opens).withColumn("run", F.sum("opens").over(of_text.orderBy("start", "last").rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*KEYS, "run").agg(F.min("start").alias("start"), F.max("last").alias("last"))
    before = F.coalesce(F.lag("last").over(of_text.orderBy("start")) + 1, F.lit(0))
    gaps = runs.withColumn("before", before).groupBy(*KEYS)
    return gaps.agg(F.sort_array(F.collect_list(F.struct(F.col("before").alias("from"), (F.col("start") - 1).alias("to")))).alias("_w_kept"), (F.max("last") + 1).alias("_w_tail"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, block_lines: int = BLOCK_LINES) -> DataFrame:
    """``docs`` without the later runs, with ``_w_n_lines`` and ``_w_n_deleted``."""
    runs = repeated_runs(docs, id_col, text_col, least_chars, block_lines)
    joined = _keyed(docs, id_col, text_col).join(runs, KEYS, "left")
    lines, hit = _lines(text_col), F.col("_w_tail").isNotNull()
    parts = F.concat("_w_kept", F.array(F.struct(F.col("_w_tail").alias("from"), (F.size(lines) - 1).alias("to"))))
    left = F.flatten(F.transform(parts, lambda p: F.slice(lines, p["from"] + 1, F.greatest(p["to"] - p["from"] + 1, F.lit(0)))))
    left_size = F.aggregate(parts, F.lit(0), lambda n, p: n + F.greatest(p["to"] - p["from"] + 1, F.lit(0)))
    deleted = F.when(hit, F.size(lines) - left_size).otherwise(0).cast("long")
    text = F.when(hit, F.array_join(left, "\n")).otherwise(F.col(text_col))
    return joined.withColumns({"_w_n_lines": F.size(lines).cast("long"), "_w_n_deleted": deleted, "_w_text": text}).withColumn(text_col, F.col("_w_text")).select(*docs.columns, "_w_n_lines", "_w_n_deleted")


#: The same counts and texts in DuckDB, by brute force over all pairs of equal lines, for ids that are unique.
SQL = """
WITH l AS (
  SELECT doc_id, pos - 1 AS i, line, trim(line) = '' AS blank
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
b AS (SELECT doc_id, i, line, length(line) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE NOT blank),
same AS (SELECT b.doc_id, a.doc_id AS f_id, b.k - a.k AS shift, b.k, b.n FROM b JOIN b a ON a.line = b.line AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.k < b.k))),
islands AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, f_id, shift ORDER BY k) AS g FROM same),
runs AS (SELECT doc_id, min(k) AS a, max(k) AS z FROM islands GROUP BY doc_id, f_id, shift, g HAVING sum(n) >= 100),
dead AS (SELECT DISTINCT b.doc_id, b.i FROM b JOIN runs r ON b.doc_id = r.doc_id AND b.k BETWEEN r.a AND r.z),
headed AS (SELECT *, max(CASE WHEN NOT blank THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS head FROM l)
SELECT h.doc_id, count(*) AS n_lines, count(dead.i) AS n_deleted,
       md5(coalesce(string_agg(h.line, chr(10) ORDER BY h.i) FILTER (WHERE dead.i IS NULL), '')) AS kept_md5
FROM headed h LEFT JOIN dead ON h.doc_id = dead.doc_id AND h.head = dead.i GROUP BY h.doc_id
"""
