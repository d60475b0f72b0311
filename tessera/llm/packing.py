"""Best-fit packing of documents into training sequences by sums of squares.

Documents become token ids and an end id; those longer than a sequence are cut
into whole sequences and a rest. A piece goes where the sum over all residual gaps of the
squared number of open sequences with that gap becomes smallest, which keeps the
gaps evenly spread and so likely to be filled exactly. Pieces come by
descending length, and a sequence is opened only if no open one has room: both
keep the number of sequences lowest at the end of a finite input.

Only lengths are packed: ids are hashed where they are made and never shuffled.
Pieces are dealt by hash to groups of about ``group_rows``, packed
independently; a group leaves about one sequence partly filled.

Edge cases: a null text is empty and gives one piece with the end id alone;
equal rows are packed separately; a null document id is kept; an empty table gives
no rows. Only the id and the text column are read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import Words, slices
from tessera.operators.storage import materialize

#: Words whose ids a Python worker remembers at most; speed only.
CACHE_WORDS = 1_200_000
_MARKS = ".,;:!?"
#: Words that are one run of letters to any tokenizer: Latin-1 letters.
_LETTERS = re.compile("[a-zß-öø-ÿÀ-ÖØ-Þ]+")
#: Pieces that are packed together, about.
GROUP_ROWS = 32_768


class Encoder:
    """Token ids of texts, by white-space separated words.

    The tokenizer drops white space and none of its tokens spans it, so a text's
    ids are those of its words, each of which is encoded once while remembered.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        #: Of each id, whether its token ends a word.
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    @classmethod
    def at(cls, path: str) -> Encoder:
        """One encoder for each vocabulary and Python worker."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _learn(self, plain: list[str], others: list[str]) -> None:
        """``plain`` words give one run of tokens each, whose last one ends a word, so that many are encoded as one text."""
        for at in range(0, len(plain), 5_000):
            part = plain[at : at + 5_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                others = others + part
                continue
            raw = ids.tobytes()
            for w, a, b in zip(part, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                self.known[w] = raw[4 * a : 4 * b]
        for at in range(0, len(others), 5_000):
            part = others[at : at + 5_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[w] = np.array(e.ids, "<u4").tobytes()

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit numbers."""
        if len(self.known) + 2 * len(words) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        if new := [w for w in words if w not in known]:
            # punctuation after a letter or digit is split off by the tokenizer too
            stems = [w.rstrip(_MARKS) for w in new]
            cut = [len(s) if s and s[-1].isascii() and s[-1].isalnum() else len(w) for w, s in zip(new, stems, strict=True)]
            parts = dict.fromkeys(x for w, n in zip(new, cut, strict=True) for x in (w[:n], w[n:]) if x and x not in known)
            self._learn([w for w in parts if _LETTERS.fullmatch(w)], [w for w in parts if not _LETTERS.fullmatch(w)])
            for w, n in zip(new, cut, strict=True):
                if n < len(w):
                    known[w] = known[w[:n]] + known[w[n:]]
        return [known[w] for w in words]

    def ids(self, texts: pa.Array, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with ``end`` after it, and the offsets of each text in them."""
        # the tokenizer lowers letters; special tokens are told by their case before that
        words = Words(texts, lower=not pc.any(pc.match_substring(texts, "<|")).as_py())
        coded = words.array().dictionary_encode()
        each = self.words(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(each), "<u4")
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        codes = coded.indices.to_numpy()
        lengths = sizes[codes] if len(codes) else np.zeros(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(lengths)))
        offsets = ends[words.docs] + np.arange(len(texts) + 1)
        doc = np.repeat(np.arange(len(texts)), np.diff(words.docs))
        out = np.full(offsets[-1], end, "<u4")
        if len(codes):
            starts = (np.cumsum(sizes) - sizes)[codes]
            step = np.arange(ends[-1])
            out[step + np.repeat(doc, lengths)] = flat[step + np.repeat(starts - ends[:-1], lengths)]
        return out, offsets


def pieces(docs: DataFrame, path: str, most: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(path)
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                ids, offsets = encoder.ids(texts, end)
                sizes = np.diff(offsets)
                n = -(-sizes // most)
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = piece * most
                length = np.minimum(sizes[doc] - start, most)
                at = (offsets[:-1][doc] + start) * 4
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length; lengths are placed from the longest on."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_by_gap: list[list[int]] = [[] for _ in range(most + 1)]
    count = np.zeros(most + 1, np.int64)
    opened, none = 0, np.iinfo(np.int64).max
    for at in np.argsort(-lengths, kind="stable"):
        size = int(lengths[at])
        # a sequence with gap g becomes one with gap g - size; a full one counts no more
        before = count[size:most]
        grown = 2 * (count[: most - size] - before) + 2
        if len(grown):
            grown[0] = 1 - 2 * before[0]
            grown[before == 0] = none
            gap = int(grown.argmin())
        if len(grown) and grown[gap] != none:
            gap += size
            where = open_by_gap[gap].pop()
            count[gap] -= 1
        else:
            gap, where, opened = most, opened, opened + 1
        sequence[at], offset[at] = where, most - gap
        if gap > size:
            open_by_gap[gap - size].append(where)
            count[gap - size] += 1
    return sequence, offset


def pack(docs: DataFrame, path: str, most: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    cut = materialize(pieces(docs, path, most, end, id_col, text_col), "pieces")
    groups = max(1, -(-cut.count() // group_rows))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        sequence, offset = sum_of_squares(rows["length"].to_numpy(), most)
        return rows.assign(sequence_id=rows["group"] + sequence * groups, offset=offset).drop(columns="group")

    dealt = cut.withColumn("group", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(groups)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("group").applyInPandas(run, schema).withColumnRenamed("id", id_col)
