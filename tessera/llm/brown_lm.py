"""Language-model scores by a Brown class-based bigram model.

log P(text) = sum over tokens of log P(class | class before) + log P(word | class). Classes come from exchange: a word
moves to the class that raises the likelihood of the training bigrams most. This is done in two steps.

1. The ``CORE`` most frequent words and the end of a text, each on its own, with all other words as one unit apart, are clustered
   by moves one at a time until none is better. Their bigram matrix has a fixed bound, whatever the corpus.
2. Every other training word, of which there are as many as the corpus has, takes one exchange step from its own counts: of
   the classes before and after each of its occurrences, against the class table of the first step.

The transitions of the model are then counted over all training tokens with the classes of all words. Emissions
are discounted by D = n1 / (n1 + 2 n2); a class's unseen words share what its seen words give up, as one type, so that a
class's emissions sum to one. An unseen word may be of any class: it has their mixture, by what each class before makes of them.

Layout: one pass cuts texts into blocks of bounded size, each a row with a dictionary of its words and codes into it. Words travel in
cells, the words of a block that fall to one part of the vocabulary; a part counts them, gives each a class and
answers every cell. No text is shuffled, and the vocabulary is never in one place. Parts follow the
size of the vocabulary; a word that a third of all tokens are is one entry of each block.

Edge cases: null and empty texts consist of the end token; a null id belongs to
the training part; equal rows are scored alike and each counts in training; without training rows
the score is the base score; an empty table gives no rows. Only the id and the text column are read. A text is never cut: a worker
needs memory in proportion to the longest text.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import Words, slices, utf8
from tessera.operators.storage import materialize

#: Words that are clustered by moves one at a time.
CORE = 2048
#: Classes; in tables the one after the last is that of all words not yet placed or, in the model, of unseen ones.
CLASSES = 64
SWEEPS = 6
#: Bytes of text in a block, and entries of block dictionaries in a part of the vocabulary.
BLOCK_BYTES, PART_WORDS = 8 << 20, 1 << 20
#: Weight of class frequencies in the transitions.
PRIOR = 64.0
#: Words that are placed at once, and counts up to which gains are tabulated.
PLACE_WORDS, SMALL = 1 << 14, 32

_MIX = np.random.default_rng(1992).integers(0, 1 << 63, 4096, np.uint64) | np.uint64(1)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def pack(x: np.ndarray) -> bytes:
    """Compressed, byte planes apart."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes())


def unpack(packed: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_words(words: pa.Array) -> bytes:
    """Words hold no line feed."""
    raw, offsets = utf8(words)
    out = np.full(len(raw) + max(0, len(words) - 1), 10, np.uint8)
    out[np.arange(len(raw)) + np.repeat(np.arange(len(words)), np.diff(offsets))] = raw
    return zstandard.ZstdCompressor(level=1).compress(out.tobytes())


def unpack_words(packed: bytes) -> pa.Array:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    if not len(raw):
        return pa.array([], pa.large_string())
    between = raw == 10
    ends = np.append(np.flatnonzero(between), len(raw))
    offsets = np.concatenate(([0], ends - np.arange(len(ends)))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(raw[~between]))


def part_of(words: pa.Array, parts: int) -> np.ndarray:
    """The part of the vocabulary that each word falls to."""
    raw, offsets = utf8(words)
    if not len(words):
        return np.zeros(0, np.int64)
    place = np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets))
    h = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * _MIX[place & 4095], offsets[:-1])
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _blocks(docs: DataFrame, id_col: str, text_col: str, held: Column) -> DataFrame:
    """A row for each block: its documents (ids, held, tokens with ends), codes of all tokens, words; the end's code is ``n_words``."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held.alias("held"))
    kind = kept.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch, "text", BLOCK_BYTES):
                words = Words(texts)
                coded = words.array().dictionary_encode()
                offsets = words.docs + np.arange(len(texts) + 1)
                codes = np.full(offsets[-1], len(coded.dictionary), np.int32)
                inside = np.ones(len(codes), bool)
                inside[offsets[1:] - 1] = False
                codes[inside] = coded.indices.to_numpy()
                one, sizes = pa.array([0, len(texts)], pa.int32()), pa.array(np.diff(offsets), pa.int64())
                held = rows.column(2)
                columns = [pa.array([random.SystemRandom().getrandbits(62)], pa.int64()), *(pa.ListArray.from_arrays(one, c) for c in (rows.column(0), held, sizes))]
                columns += [pa.array([x], pa.binary()) for x in (pack(codes), pack_words(coded.dictionary))]
                columns += [pa.array([n], pa.int64()) for n in (len(coded.dictionary), len(texts) - (pc.sum(held).as_py() or 0))]
                yield pa.RecordBatch.from_arrays(columns, ["block", "ids", "held", "sizes", "codes", "words", "n_words", "n_train"])

    return kept.mapInArrow(run, f"block long, ids array<{kind}>, held array<boolean>, sizes array<long>, codes binary, words binary, n_words long, n_train long")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, words, codes, offsets of documents, whether a token teaches) of rows (block, held, sizes, codes, words)."""
    for batch in batches:
        for i in range(len(batch)):
            block, held, sizes, codes, words = (c[i] for c in batch.columns[:5])
            sizes = sizes.values.to_numpy()
            teaches = np.repeat(~held.values.to_numpy(zero_copy_only=False), sizes)
            yield block.as_py(), unpack_words(words.as_py()), unpack(codes.as_py(), np.int32), np.concatenate(([0], np.cumsum(sizes))), teaches


OPENED = ["block", "held", "sizes", "codes", "words"]


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Runs of rows with the same first column."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != now and rows:
                yield now, rows
                rows = []
            now = row[0]
            rows.append(row)
    if rows:
        yield now, rows


def _cells(parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, its entries in order)."""
    order = np.argsort(parts, kind="stable")
    cuts = np.flatnonzero(np.diff(parts[order])) + 1
    for at in np.split(order, cuts) if len(order) else []:
        yield int(parts[at[0]]), at


def most_frequent(blocks: DataFrame, parts: int, core: int) -> DataFrame:
    """(word, c, types, once, twice): of each part of the vocabulary its ``core`` most frequent training words; with null for a word its totals."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, codes, _, teaches in _opened(batches):
            n = np.bincount(codes[teaches], minlength=len(words) + 1)[: len(words)]
            known = np.flatnonzero(n)
            out = [(p, pack_words(words.take(pa.array(known[at]))), pack(n[known[at]])) for p, at in _cells(part_of(words.take(pa.array(known)), parts))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["part", "words", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(batches):
            coded = pa.chunked_array([unpack_words(r[1]) for r in rows], pa.large_string()).combine_chunks().dictionary_encode()
            c = np.bincount(coded.indices.to_numpy(), np.concatenate([unpack(r[2], np.int64) for r in rows]), len(coded.dictionary)).astype(np.int64)
            least = np.sort(c)[::-1][min(core, len(c)) - 1]
            more, same = np.flatnonzero(c > least), np.flatnonzero(c == least)
            by_word = pc.sort_indices(coded.dictionary.take(pa.array(same))).to_numpy()
            best = np.concatenate((more, same[by_word[: core - len(more)]]))
            none = [None] * len(best)
            columns = [[*coded.dictionary.take(pa.array(best)).to_pylist(), None], [*c[best].tolist(), int(c.sum())], [*none, len(c)], [*none, int((c == 1).sum())], [*none, int((c == 2).sum())]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), *[pa.int64()] * 4), strict=True)], ["word", "c", "types", "once", "twice"])

    cells = blocks.select(*OPENED).mapInArrow(split, "part long, words binary, n binary")
    return cells.repartition("part").sortWithinPartitions("part").mapInArrow(count, "word string, c long, types long, once long, twice long")


def core_bigrams(blocks: DataFrame, core: list[str]) -> np.ndarray:
    """How often one unit follows another in training: core words, then the end, then all others. A text follows an end."""
    m = len(core) + 2
    sent = blocks.sparkSession.sparkContext.broadcast(core)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.large_string())
        for _, words, codes, offsets, teaches in _opened(batches):
            unit = np.append(pc.fill_null(pc.index_in(words, known), m - 1).to_numpy(), m - 2).astype(np.int32)
            after = unit[codes]
            before = np.empty_like(after)
            before[1:] = after[:-1]
            before[offsets[:-1]] = m - 2
            pair, n = np.unique((before.astype(np.int32) * m + after)[teaches], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int32()), pa.array(n, pa.int64())], ["pair", "n"])

    table = blocks.select(*OPENED).mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(m * m)
    out[table["pair"].to_numpy()] = table["n"].to_numpy()
    return out.reshape(m, m)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS, apart: int | None = None) -> np.ndarray:
    """The class of each unit: units move to the class with the highest likelihood until none does.

    ``apart``: a unit that stays alone in a further class, the last.
    """
    m = len(bigrams)
    weight = bigrams.sum(0) + bigrams.sum(1)
    order = np.argsort(-weight, kind="stable")
    order = order[order != apart]
    member = np.zeros(m, np.int64)
    member[order] = np.arange(len(order)) % classes
    open_, all_ = classes, classes + (apart is not None)
    if apart is not None:
        member[apart] = classes
    onto = np.zeros((m, all_))
    onto[np.arange(m), member] = 1
    table = onto.T @ bigrams @ onto
    for _ in range(sweeps):
        moved = 0
        for u in order[weight[order] > 0].tolist():
            here, loop = member[u], bigrams[u, u]
            after = np.bincount(member, bigrams[u], all_)
            before = np.bincount(member, bigrams[:, u], all_)
            table[here] -= after
            table[:, here] -= before
            table[here, here] += loop
            after[here] -= loop
            before[here] -= loop
            rows, columns = table.sum(1) + before, table.sum(0) + after
            gain = (_xlogx(table + after) - _xlogx(table)).sum(1) + (_xlogx(table.T + before) - _xlogx(table.T)).sum(1)
            own, a, b = np.diag(table), after, before
            gain += _xlogx(own + a + b + loop) - _xlogx(own + a) - _xlogx(own + b) + _xlogx(own)
            gain -= _xlogx(rows + after.sum() + loop) - _xlogx(rows) + _xlogx(columns + before.sum() + loop) - _xlogx(columns)
            to = int(gain[:open_].argmax())
            if gain[to] <= gain[here] + 1e-9:
                to = here
            table[to] += after
            table[:, to] += before
            table[to, to] += loop
            moved += to != here
            member[u] = to
        if not moved:
            break
    return member


class Placing:
    """One exchange step of words out of the last class of a table, that of words without a class, into one of the others.

    A word's bigrams are in that class's row and column already, so that of the sums only those of the class it joins change.
    """

    def __init__(self, table: np.ndarray):
        self.table, self.classes = table, len(table) - 1
        n = np.arange(1, SMALL + 1)
        self.rows, self.columns = table.sum(1)[:-1], table.sum(0)[:-1]
        self.small = [self._cells(side, np.repeat(np.arange(len(table)), SMALL), np.tile(n, len(table))).reshape(len(table), SMALL, -1) for side in (0, 1)]

    def _cells(self, side: int, other: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What ``n`` bigrams with the class ``other`` before (side 0) or after a word add for each class of the word."""
        had = (self.table if side == 0 else self.table.T)[other, :-1]
        return (_xlogx(had + n[:, None]) - _xlogx(had)).astype(np.float32)

    def classes_of(self, word: np.ndarray, left: np.ndarray, right: np.ndarray, n_words: int) -> np.ndarray:
        """The class of each of the words 0 to ``n_words`` - 1 from its occurrences: the word, the class before and the class after."""
        width, out = len(self.table), np.zeros(n_words, np.uint8)
        sides = []
        for other in (left, right):
            key, n = np.unique(word * width + other, return_counts=True)
            sides.append((key // width, key % width, n))
        total = np.bincount(word, minlength=n_words)
        (w, k, n), (w2, k2, n2) = sides
        both, i, j = np.intersect1d(w * width + k, w2 * width + k2, assume_unique=True, return_indices=True)
        i, j = i[both % width < self.classes], j[both % width < self.classes]
        own = np.diag(self.table)[k[i]]
        loops = (w[i], k[i], _xlogx(own + n[i] + n2[j]) - _xlogx(own + n[i]) - _xlogx(own + n2[j]) + _xlogx(own))
        for at in range(0, n_words, PLACE_WORDS):
            to = min(n_words, at + PLACE_WORDS)
            size = total[at:to, None].astype(float)
            gain = (_xlogx(self.rows) - _xlogx(self.rows + size) + _xlogx(self.columns) - _xlogx(self.columns + size)).astype(np.float32)
            for side, (w, other, n) in enumerate(sides):
                lo, hi = np.searchsorted(w, (at, to))
                if lo == hi:
                    continue
                w, other, n = w[lo:hi] - at, other[lo:hi], n[lo:hi]
                cells = self.small[side][other, np.minimum(n, SMALL) - 1]
                large = np.flatnonzero(n > SMALL)
                if len(large):
                    cells[large] = self._cells(side, other[large], n[large])
                heads = np.flatnonzero(np.diff(w, prepend=-1))
                gain[w[heads]] += np.add.reduceat(cells, heads)
            lo, hi = np.searchsorted(loops[0], (at, to))
            gain[loops[0][lo:hi] - at, loops[1][lo:hi]] += loops[2][lo:hi].astype(np.float32)
            out[at:to] = gain.argmax(1)
        return out


def placed_words(blocks: DataFrame, parts: int, core: dict[str, int], counts: list[int], member: np.ndarray, table: np.ndarray) -> DataFrame:
    """(block, codes, k, c): class and training count of each dictionary entry, in cells; rows without a block: (tokens, types) of each class."""
    sc = blocks.sparkSession.sparkContext
    shared = sc.broadcast((list(core), np.array(counts, np.int64), member, table))
    schema = "part long, block long, codes binary, words binary, n binary, left binary, right binary, k binary, c binary"
    binary, names = pa.binary(), ["part", "block", "codes", "words", "n", "left", "right", "k", "c"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, c, member, _ = shared.value
        known, end, rest = pa.array(listed, pa.large_string()), len(listed), len(listed) + 1
        for block, words, codes, offsets, teaches in _opened(batches):
            unit = np.append(pc.fill_null(pc.index_in(words, known), rest).to_numpy(), end).astype(np.int64)
            k = member[unit].astype(np.uint8)
            of_token = k[codes]
            left, right = np.empty_like(of_token), np.empty_like(of_token)
            left[1:], right[:-1] = of_token[:-1], of_token[1:]
            left[offsets[:-1]] = k[-1]
            sure, open_ = np.flatnonzero(unit < rest), np.flatnonzero(unit == rest)
            out = [(-1, block, pack(sure.astype(np.int32)), None, None, None, None, pack(k[sure]), pack(c[unit[sure]]))]
            parted = part_of(words.take(pa.array(open_)), parts)
            order = np.argsort(parted, kind="stable")
            rank = np.zeros(len(unit), np.int32)
            rank[open_[order]] = np.arange(len(open_))
            tokens = np.flatnonzero(teaches & (unit[codes] == rest))
            tokens = tokens[np.argsort(rank[codes[tokens]], kind="stable")]
            n = np.bincount(rank[codes[tokens]], minlength=len(open_))
            ends = np.concatenate(([0], np.cumsum(n)))
            left, right, at = left[tokens], right[tokens], 0
            for p, mine in _cells(parted):
                a, b = ends[at], ends[at + len(mine)]
                out.append((p, block, pack(open_[mine].astype(np.int32)), pack_words(words.take(pa.array(open_[mine]))), pack(n[at : at + len(mine)]), pack(left[a:b]), pack(right[a:b]), None, None))
                at += len(mine)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64() if i < 2 else binary) for i in range(9)], names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placing = Placing(shared.value[3])
        classes = placing.classes
        lists = pa.list_(pa.int64())
        for part, rows in _by_key(batches):
            coded = pa.chunked_array([unpack_words(r[3]) for r in rows], pa.large_string()).combine_chunks().dictionary_encode()
            word, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            n = np.concatenate([unpack(r[4], np.int64) for r in rows])
            left, right = (np.concatenate([unpack(r[i], np.uint8) for r in rows]) for i in (5, 6))
            c = np.bincount(word, n, size).astype(np.int64)
            k = placing.classes_of(np.repeat(word, n), left, right, size)
            k[c == 0] = classes
            cuts = np.cumsum([0, *(len(unpack(r[4], np.int64)) for r in rows)])
            own = [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            none = [None] * len(rows)
            columns = [
                pa.array([*(r[1] for r in rows), None], pa.int64()),
                pa.array([*(r[2] for r in rows), None], binary),
                pa.array([*(pack(k[w]) for w in own), None], binary),
                pa.array([*(pack(c[w]) for w in own), None], binary),
                pa.array([*none, np.bincount(k[c > 0], c[c > 0], classes).astype(np.int64)], lists),
                pa.array([*none, np.bincount(k[c > 0], minlength=classes)], lists),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["block", "codes", "k", "c", "tokens", "types"])

    cells = materialize(blocks.select(*OPENED).mapInArrow(split, schema), "cells")
    moved = cells.where("part >= 0").repartition("part").sortWithinPartitions("part", "block")
    answered = moved.mapInArrow(place, "block long, codes binary, k binary, c binary, tokens array<long>, types array<long>")
    sure = cells.where("part < 0").select("block", "codes", "k", "c", *[F.lit(None).cast("array<long>").alias(x) for x in ("tokens", "types")])
    return answered.unionByName(sure)


def classed_blocks(blocks: DataFrame, placed: DataFrame) -> DataFrame:
    """Blocks with class and count of each dictionary entry, and the class bigrams of their training tokens."""
    main = blocks.select("block", F.lit(0).alias("row"), "ids", "held", "sizes", "codes", *[F.lit(None).cast("binary").alias(x) for x in ("k", "c")])
    ids = blocks.schema["ids"].dataType
    cells = placed.where("block is not null").select("block", F.lit(1).alias("row"), F.lit(None).cast(ids).alias("ids"), F.lit(None).cast("array<boolean>").alias("held"), F.lit(None).cast("array<long>").alias("sizes"), "codes", "k", "c")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, cells, kind = None, [], None

        def result() -> pa.RecordBatch:
            _, _, ids, held, sizes, packed, _, _ = first
            codes, sizes = unpack(packed, np.int32), np.array(sizes, np.int64)
            at = [unpack(x[5], np.int32) for x in cells]
            size = sum(map(len, at))
            k, c = np.zeros(size, np.uint8), np.zeros(size, np.int64)
            for where, x in zip(at, cells, strict=True):
                k[where], c[where] = unpack(x[6], np.uint8), unpack(x[7], np.int64)
            after = k[codes].astype(np.int64)
            before = np.empty_like(after)
            before[1:] = after[:-1]
            before[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = k[-1]
            teaches = np.repeat(~np.array(held, bool), sizes)
            table = np.bincount((before * (CLASSES + 1) + after)[teaches], minlength=(CLASSES + 1) ** 2)
            lists = pa.list_(pa.int64())
            columns = [pa.array([ids], kind), pa.array([held], pa.list_(pa.bool_())), pa.array([sizes], lists), *(pa.array([x], pa.binary()) for x in (packed, pack(k), pack(c))), pa.array([table], lists)]
            return pa.RecordBatch.from_arrays(columns, ["ids", "held", "sizes", "codes", "k", "c", "bigrams"])

        for batch in batches:
            kind = batch.schema.field("ids").type
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if row[1] == 0:
                    if first is not None:
                        yield result()
                    first, cells = row, []
                else:
                    cells.append(row)
        if first is not None:
            yield result()

    both = main.unionByName(cells).repartition("block").sortWithinPartitions("block", "row")
    return both.mapInArrow(join, f"ids {ids.simpleString()}, held array<boolean>, sizes array<long>, codes binary, k binary, c binary, bigrams array<long>")


@dataclass
class Model:
    """What scoring needs beside class and count of each word; its size does not depend on the corpus."""

    transition: np.ndarray
    tokens_of: np.ndarray
    types_of: np.ndarray
    discount: float
    tokens: int
    types: int

    @classmethod
    def of(cls, table: np.ndarray, tokens_of: np.ndarray, types_of: np.ndarray, once: int, twice: int) -> Model:
        """``table``: class bigrams of the training tokens; the last class, that of unseen words, is a mixture of the others."""
        k = len(tokens_of)
        discount = once / (once + 2 * twice) if once and twice else 0.5
        share = (tokens_of + 1) / (tokens_of.sum() + k)
        known = (table[:k, :k] + PRIOR * share) / (table[:k, :k].sum(1, keepdims=True) + PRIOR)
        unseen = np.where(tokens_of > 0, discount * types_of / np.maximum(tokens_of, 1), 1.0)
        of_unseen = share * unseen / (share * unseen).sum()
        full = np.empty((k + 1, k + 1))
        full[:k, :k], full[k, :k] = known, of_unseen @ known
        full[:, k] = full[:, :k] @ unseen
        return cls(np.log10(full), tokens_of, types_of, discount, int(tokens_of.sum()), int(types_of.sum()))

    def emission(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 P(word | class) of words with these training counts; that of unseen words is in the transitions."""
        total = np.append(self.tokens_of, 1)[classes]
        return np.where(counts > 0, np.log10(np.maximum(counts - self.discount, 1e-12) / np.maximum(total, 1)), 0.0)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None, core: int = CORE) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of each row; rows with ``held`` teach nothing."""
    held = held_out(id_col) if held is None else held
    spark = docs.sparkSession
    blocks = materialize(_blocks(docs, id_col, text_col, held), "blocks")
    entries, ends = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    parts = max(1, -(-entries // PART_WORDS))
    found = materialize(most_frequent(blocks, parts, core), "frequent")
    seen = found.where("word is null").agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("types", "once", "twice")]).first()
    best = {r["word"]: r["c"] for r in found.where("word is not null").orderBy(F.desc("c"), "word").limit(core).collect()}
    bigrams = core_bigrams(blocks, list(best))
    rest = len(best) + 1
    member = exchange(bigrams, CLASSES, apart=rest)
    onto = np.eye(CLASSES + 1)[member]
    placed = materialize(placed_words(blocks, parts, best, [*best.values(), ends], member, onto.T @ bigrams @ onto), "placed")
    ready = materialize(classed_blocks(blocks, placed), "classed")
    model = None
    if ends:
        own = np.array([*best.values(), ends])
        tokens_of, types_of = np.bincount(member[:rest], own, CLASSES), np.bincount(member[:rest], minlength=CLASSES)
        for r in placed.where("tokens is not null").select(F.posexplode(F.arrays_zip("tokens", "types")).alias("k", "x")).groupBy("k").agg(F.sum("x.tokens").alias("tokens"), F.sum("x.types").alias("types")).collect():
            tokens_of[r["k"]] += r["tokens"]
            types_of[r["k"]] += r["types"]
        table = np.zeros((CLASSES + 1) ** 2)
        for r in ready.select(F.posexplode("bigrams").alias("at", "n")).where("n > 0").groupBy("at").agg(F.sum("n").alias("n")).collect():
            table[r["at"]] = r["n"]
        model = Model.of(table.reshape(CLASSES + 1, -1), tokens_of, types_of, seen[1] + (ends == 1), seen[2] + (ends == 2))
    tokens, types = (model.tokens, model.types) if model else (0, 0)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = shared.value, np.add.reduceat
        for batch in batches:
            for i in range(len(batch)):
                ids, held, sizes, codes, k, c = (x[i] for x in batch.columns)
                codes, k, c = unpack(codes.as_py(), np.int32), unpack(k.as_py(), np.uint8), unpack(c.as_py(), np.int64)
                sizes = sizes.values.to_numpy()
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                base = np.log10((c + 1) / (tokens + types + 1))[codes]
                each = base
                if m:
                    now = k[codes]
                    before = np.empty_like(now)
                    before[1:] = now[:-1]
                    before[starts] = k[-1]
                    each = m.transition[before, now] + m.emission(c, k)[codes]
                scores = total(each, starts)
                columns = [ids.values, held.values, pa.array(sizes), pa.array(total((c > 0)[codes].astype(np.int64), starts)), pa.array(np.full(len(sizes), tokens)), pa.array(total(base, starts)), pa.array(scores), pa.array(10 ** (-scores / sizes))]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    kind = docs.schema[id_col].dataType.simpleString()
    return ready.select("ids", "held", "sizes", "codes", "k", "c").mapInArrow(run, f"{id_col} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
