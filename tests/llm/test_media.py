"""Stored media against a plain version of the two tables."""

import hashlib
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard

from tessera.llm import gear, media_chunks as M
from tests.llm.test_brute import by_id


def padded(text):
    raw = (text or "").encode()
    return raw.ljust(max(192, -(-len(raw) // 192) * 192))


def cut(payload):
    _, starts, ends = gear.chunks(np.frombuffer(payload, np.uint8), np.array([0, len(payload)]), M.BITS, M.MOST)
    return [payload[a:b] for a, b in zip(starts, ends, strict=True)]


def test_stored_forms_and_features_are_the_plain_ones(docs, rows):
    got = by_id(M.media(docs))
    chunks = {p: cut(p) for p in {padded(r[1]) for r in rows}}
    shared = {c for c, n in Counter(c for cs in chunks.values() for c in set(cs)).items() if n > 1}
    press = zstandard.ZstdCompressor(level=M.LEVEL)
    for i, text, *_ in rows:
        payload, r = padded(text), got[i]
        mine = chunks[payload]
        record = struct.pack("<6sQI", b"MCDC2\0", len(payload), len(mine)) + b"".join(struct.pack("<I16s", len(c), xxhash.xxh3_128_digest(c)) for c in mine)
        record += np.packbits([c in shared for c in mine]).tobytes() + press.compress(b"".join(c for c in mine if c not in shared))
        stored = record + b"".join(press.compress(c) for c in mine if c in shared)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert (r["n_chunks"], r["n_shared"]) == (len(mine), sum(c in shared for c in mine))
        n, mean, spread, entropy, shares = r["feature"].split(":")
        p = [sum(b >> 4 == v for b in payload) / len(payload) for v in range(16)]
        assert int(n) == len(mine) and float(mean) == pytest.approx(sum(payload) / len(payload), abs=1e-4)
        assert float(spread) == pytest.approx((sum((b - sum(payload) / len(payload)) ** 2 for b in payload) / len(payload)) ** 0.5, abs=1e-3)
        assert float(entropy) == pytest.approx(-sum(x * np.log2(x) for x in p if x), abs=1e-4)
        assert [float(x) for x in shares.split(",")] == pytest.approx(p, abs=1e-3)
    assert sum(r["n_shared"] > 0 for r in got.values()) >= 5 and sum(r["n_chunks"] > 1 for r in got.values()) > len(rows) // 2


def test_a_full_filter_changes_nothing_but_where_chunks_are_kept(docs, monkeypatch):
    want = by_id(M.media(docs))
    monkeypatch.setattr(M, "shared_filter", lambda entries: np.full(32, 0xFFFFFFFF, np.uint32))
    got = by_id(M.media(docs))
    same = ("payload_sha256", "tail_crc32", "feature", "n_chunks")
    assert all(tuple(r[c] for c in same) == tuple(want[i][c] for c in same) for i, r in got.items())
    assert all(r["n_shared"] == r["n_chunks"] for r in got.values())


def test_damage_is_noticed():
    press = zstandard.ZstdCompressor(level=M.LEVEL)
    chunks = [b"a" * 40, b"b" * 24]
    digests = [xxhash.xxh3_128_digest(c) for c in chunks]
    key, stored = hashlib.sha256(b"".join(chunks)).digest(), np.array([False, True])
    blob = M.record(chunks, digests, stored, press)
    assert M.rebuilt(key, blob, {digests[1]: press.compress(chunks[1])})[1] == 64
    for bad in ({}, {digests[1]: press.compress(b"c" * 24)}):
        with pytest.raises(ValueError, match="chunk"):
            M.rebuilt(key, blob, bad)
    with pytest.raises(ValueError, match="payload"):
        M.rebuilt(b"x" * 32, blob, {digests[1]: press.compress(chunks[1])})
