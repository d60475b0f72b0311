"""Vectorised text primitives shared by the operators of this package.

Words are runs of bytes other than the six ASCII white-space characters, so that
they can be cut from the UTF-8 buffer of an Arrow column without a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once in a Python worker; bounds its memory.
SLICE_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The column with null as the empty text, with 64-bit offsets."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(column)), "").cast(pa.large_string())


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Runs of rows whose texts come to about ``most`` bytes (one row at least), with these texts."""
    texts = texts_of(batch, column)
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at), texts.slice(at, to - at)
        at = to


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each text in them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = texts.buffers()[2]
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, offsets - offsets[0]


class Words:
    """All words of some texts.

    ``data``: their bytes, one after the other; ``starts``: where each begins, with
    the end of the last; ``docs``: the first word of each text, with their number.
    """

    def __init__(self, texts: pa.Array, lower: bool = True):
        raw, offsets = utf8(pc.ascii_lower(texts) if lower else texts)
        word = ~_SPACE[raw]
        first = word.copy()
        first[1:] &= ~word[:-1]
        heads = offsets[:-1][np.diff(offsets) > 0]
        first[heads] = word[heads]
        at = np.flatnonzero(first)
        self.docs = np.searchsorted(at, offsets)
        self.data = raw[word]
        self.starts = np.append(np.flatnonzero(first[word]), len(self.data))

    def __len__(self) -> int:
        return len(self.starts) - 1

    def array(self) -> pa.Array:
        """The words as an Arrow array, without a copy."""
        return pa.LargeStringArray.from_buffers(len(self), pa.py_buffer(self.starts.astype(np.int64)), pa.py_buffer(self.data))

    def spaced(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words joined by single spaces, and where each begins and ends."""
        lengths = np.diff(self.starts)
        begins = self.starts[:-1] + np.arange(len(self))
        out = np.full(len(self.data) + len(self), 0x20, np.uint8)
        keep = np.ones(len(out), bool)
        keep[begins + lengths] = False
        out[keep] = self.data
        return out.tobytes(), begins, begins + lengths


def codepoints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts and the offsets of each text in them."""
    raw, _ = utf8(texts)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, np.concatenate(([0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False)))).astype(np.int64)
