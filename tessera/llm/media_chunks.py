"""Media columns stored as deduplicated content-defined chunks.

A payload is cut by a gear rolling hash. Digests of chunks are counted over all distinct payloads by Spark aggregates. What is stored are two
tables, written to the shared folder and read back:

* media: for each payload a record of a header, the ordered list of its chunks (length and digest), a bit for each chunk that tells
  whether it is kept in the store, and the bytes of all others, compressed together;
* store: by digest, the compressed bytes of each chunk that several payloads have, once.

Reading back joins the records with the store, verifies every chunk against its digest, and puts the payload together; its digest
must be that of the list. ``media_bytes`` and ``media_sha256`` are those of a payload's record followed by its
chunks of the store in order, as they were read.

Equal payloads share one record, so a text that a third of all rows have is stored once by each task that meets it and read once. Payloads without a chunk
in the store are read without a shuffle. A Bloom filter tells tasks which digests are shared; its size follows their number up to
``MOST_FILTER_BITS``. A digest that it holds wrongly is kept in the store without need; none is missed, so that a full filter costs disk only.

Edge cases: a null text is empty and is stored as padding; repeated rows get equal values;
null ids are kept; an empty table gives no rows. Only the id and the text
column are read. A worker needs memory in proportion to the longest text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import gear
from tessera.llm.joins import join_counted
from tessera.llm.text import slices, utf8
from tessera.operators.storage import materialize

#: log2 of the mean bytes of a chunk.
BITS = 9
#: Bytes of a chunk at most.
MOST = 1 << 13
#: Payloads are padded to a multiple of this.
FRAME = 192
#: Digests that a task remembers to write what it has met before once only.
REMEMBERED = 200_000
LEVEL = 6
#: Bits of the filter for each shared digest, and in all.
BITS_A_DIGEST, LEAST_FILTER_BITS, MOST_FILTER_BITS = 12, 1 << 16, 1 << 30

#: An entry of a chunk list: length and digest; the header: mark, bytes of the payload, chunks.
ENTRY, ENTRY_BYTES, HEAD, MARK = "<I16s", 20, "<6sQI", b"MCDC2\0"


def key_of(payload: bytes) -> bytes:
    """What names a payload: 128 bits of its digest."""
    return hashlib.sha256(payload).digest()[:16]


def payloads(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes, padded by spaces to a positive multiple of the frame."""
    raw, offsets = utf8(texts)
    whole = raw.tobytes()
    cut = [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return [p.ljust(max(1, -(-len(p) // FRAME)) * FRAME) for p in cut]


def chunk_list(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], bytes]:
    """(payload, start, end) of the chunks of all payloads, their digests, and the payloads in a row."""
    whole = b"".join(parts)
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    doc, starts, ends = gear.chunks(np.frombuffer(whole, np.uint8), offsets, BITS, MOST)
    view, digest = memoryview(whole), xxhash.xxh3_128_digest
    return doc, starts, ends, [digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], whole


def lists(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, n_bytes, list): of each row, the first half of its payload's digest and its ordered chunk list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                parts = payloads(texts)
                doc, starts, ends, digests, _ = chunk_list(parts)
                packed = b"".join([struct.pack(ENTRY, n, d) for n, d in zip((ends - starts).tolist(), digests, strict=True)])
                firsts = np.searchsorted(doc, np.arange(len(parts) + 1)) * ENTRY_BYTES
                entries = [packed[a:b] for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)]
                keys = [key_of(p) for p in parts]
                n = np.diff(utf8(texts)[1])
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(entries, pa.binary())], ["id", "key", "n_bytes", "list"])

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, key binary, n_bytes long, list binary")


def _slots(digests: list[bytes], size: int) -> np.ndarray:
    """Four bits of a filter of ``size`` bits for each digest, a row of four 32-bit numbers."""
    return np.frombuffer(b"".join(digests), "<u4").reshape(-1, 4) & np.uint32(size - 1)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, digest) of each entry of (key, list)."""
    for batch in batches:
        keys, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        counts = np.array([len(x) for x in lists], np.int64) // ENTRY_BYTES
        entries = np.frombuffer(b"".join(lists), np.uint8).reshape(-1, ENTRY_BYTES)[:, 4:].tobytes()
        digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), int(counts.sum()), [None, pa.py_buffer(entries)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).take(pa.array(np.repeat(np.arange(len(keys)), counts))), digests], ["key", "digest"])


def shared_filter(entries: DataFrame) -> np.ndarray:
    """A Bloom filter of the digests that two payloads or more have; ``entries``: (key, list) of each row."""
    found = entries.select("key", "list").mapInArrow(_spread, "key binary, digest binary").groupBy("digest").agg(F.min("key").alias("a"), F.max("key").alias("b"))
    shared = materialize(found.where("a <> b").select("digest"), "shared")
    wanted = max(LEAST_FILTER_BITS, min(MOST_FILTER_BITS, shared.count() * BITS_A_DIGEST))
    size = 1 << (wanted - 1).bit_length()

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_slots(batch.column(0).to_pylist(), size))
            yield pa.RecordBatch.from_arrays([pa.array((at >> 5).astype(np.int32)), pa.array(np.int64(1) << (at & 31).astype(np.int64))], ["word", "bits"])

    words = shared.mapInArrow(slots, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size >> 5, np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out


def may_be_shared(filter_: np.ndarray, digests: list[bytes]) -> np.ndarray:
    at = _slots(digests, len(filter_) << 5)
    return ((filter_[at >> np.uint32(5)] >> (at & np.uint32(31))) & np.uint32(1)).all(axis=1)


def record(chunks: list[bytes], digests: list[bytes], stored: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    """What is written for one payload."""
    entries = b"".join([struct.pack(ENTRY, len(c), d) for c, d in zip(chunks, digests, strict=True)])
    own = b"".join([c for c, s in zip(chunks, stored.tolist(), strict=True) if not s])
    return struct.pack(HEAD, MARK, sum(map(len, chunks)), len(chunks)) + entries + np.packbits(stored).tobytes() + press.compress(own)


def opened(blob: bytes) -> tuple[int, list[tuple[int, bytes]], np.ndarray, bytes]:
    """(bytes of the payload, entries, which of them are in the store, own bytes) of a record."""
    mark, size, n = struct.unpack_from(HEAD, blob)
    if mark != MARK:
        raise ValueError("not a record of this format")
    at = struct.calcsize(HEAD)
    entries = list(struct.iter_unpack(ENTRY, blob[at : at + n * ENTRY_BYTES]))
    at += n * ENTRY_BYTES
    stored = np.unpackbits(np.frombuffer(blob[at : at + -(-n // 8)], np.uint8), count=n).astype(bool)
    return size, entries, stored, zstandard.ZstdDecompressor().decompress(blob[at + -(-n // 8) :])


def written(docs: DataFrame, filter_: np.ndarray, text_col: str = "text") -> DataFrame:
    """Rows (key, n_stored, bytes) of records and (digest, bytes) of chunks that the filter calls shared, each once a task."""
    known = docs.sparkSession.sparkContext.broadcast(filter_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, sent = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True), set()

        def first(what: bytes) -> bool:
            if what in sent:
                return False
            if len(sent) >= REMEMBERED:
                sent.clear()
            sent.add(what)
            return True

        for batch in batches:
            for _, texts in slices(batch, "text"):
                parts = payloads(texts)
                doc, starts, ends, digests, whole = chunk_list(parts)
                shared, firsts = may_be_shared(known.value, digests), np.searchsorted(doc, np.arange(len(parts) + 1)).tolist()
                out = []
                for p, payload in enumerate(parts):
                    if not first(key := key_of(payload)):
                        continue
                    a, b = firsts[p], firsts[p + 1]
                    chunks = [whole[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                    out.append((key, int(shared[a:b].sum()), None, record(chunks, digests[a:b], shared[a:b], press)))
                    out += [(None, None, digests[a + i], press.compress(chunks[i])) for i in np.flatnonzero(shared[a:b]).tolist() if first(digests[a + i])]
                columns = zip(*out, strict=True) if out else ([], [], [], [])
                types = (pa.binary(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "n_stored", "digest", "bytes"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "key binary, n_stored long, digest binary, bytes binary")


def features(samples: np.ndarray, n_chunks: int) -> str:
    """Chunks, mean, deviation and entropy of the upper four bits of the samples, and the share of each of their values."""
    share = np.bincount(samples >> 4, minlength=16) / len(samples)
    spread = share[share > 0]
    return f"{n_chunks}:{samples.mean():.4f}:{samples.std():.4f}:{-(spread * np.log2(spread)).sum():.4f}:" + ",".join(f"{x:.3f}" for x in share)


RESULT = pa.schema([("key", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.binary()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.binary()), ("feature", pa.string()), ("n_chunks", pa.int64()), ("n_shared", pa.int64())])


def rebuilt(key: bytes, blob: bytes, frames: dict[bytes, bytes]) -> tuple:
    """A row of ``RESULT`` from a record and the store's chunks; whatever differs from its digest is an error."""
    size, entries, stored, own = opened(blob)
    expand, digest_of = zstandard.ZstdDecompressor(), xxhash.xxh3_128_digest
    media, media_bytes, parts, at = hashlib.sha256(blob), len(blob), [], 0
    for (length, digest), kept in zip(entries, stored.tolist(), strict=True):
        if kept:
            if digest not in frames:
                raise ValueError("a chunk is missing in the store")
            frame = frames[digest]
            media.update(frame)
            media_bytes += len(frame)
            part = expand.decompress(frame)
        else:
            part, at = own[at : at + length], at + length
        if len(part) != length or digest_of(part) != digest:
            raise ValueError("a chunk differs from its digest")
        parts.append(part)
    payload = b"".join(parts)
    whole = hashlib.sha256(payload).digest()
    if len(payload) != size or whole[: len(key)] != key:
        raise ValueError("a payload differs from its digest")
    return key, size, whole, zlib.crc32(payload[-16:]), media_bytes, media.digest(), features(np.frombuffer(payload, np.uint8), len(parts)), len(parts), int(stored.sum())


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RESULT, strict=True)], schema=RESULT)


def read_back(records: DataFrame, store: DataFrame) -> DataFrame:
    """A row of ``RESULT`` for each record, read from both tables; those of equal payloads may repeat."""
    ddl = "key binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string, n_chunks long, n_shared long"

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield _table([rebuilt(k, b, {}) for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, d) for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for d in {d for (_, d), s in zip(*opened(b)[1:3], strict=True) if s}]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], ["key", "digest"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blob, frames = None, None, {}
        for batch in batches:
            out = []
            for key, digest, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if now is not None:
                        out.append(rebuilt(now, blob, frames))
                    now, blob, frames = key, None, {}
                if digest is None:
                    blob = data
                else:
                    frames[digest] = data
            if out:
                yield _table(out)
        if now is not None:
            yield _table([rebuilt(now, blob, frames)])

    mixed = records.where("n_stored > 0").select("key", "bytes")
    wanted = materialize(mixed.mapInArrow(needs, "key binary, digest binary").distinct(), "wanted")
    fetched = join_counted(wanted, store.join(wanted.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "digest"), ["digest"]).select("key", "digest", "bytes")
    rows = mixed.select("key", F.lit(None).cast("binary").alias("digest"), "bytes").unionByName(fetched)
    built = rows.repartition("key").sortWithinPartitions("key", "digest").mapInArrow(build, ddl)
    return records.where("n_stored = 0").select("key", "bytes").mapInArrow(alone, ddl).unionByName(built)


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_chunks, n_shared) of each row."""
    rows = materialize(lists(docs, id_col, text_col), "lists")
    filter_ = shared_filter(rows)
    media_ = materialize(written(docs, filter_, text_col), "media")
    store = materialize(media_.where("digest is not null").select("digest", "bytes").dropDuplicates(["digest"]), "store")
    made = read_back(media_.where("key is not null"), store).dropDuplicates(["key"])
    counted = made.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    told = join_counted(rows.select(F.col("id").alias(id_col), "n_bytes", "key"), materialize(counted, "read"), ["key"]).drop("key")
    return told.withColumns({c: F.lower(F.hex(c)) for c in ("payload_sha256", "media_sha256")})
