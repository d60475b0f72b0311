"""Content-defined chunking with a gear rolling hash, over many texts at once."""

from __future__ import annotations

import numpy as np

#: Bytes that a cut depends on: the hash has so many bits and shifts by one for each byte.
WINDOW = 16

_GEAR = np.random.default_rng(2016).integers(0, 1 << WINDOW, 256, dtype=np.uint16)


def rolling(raw: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, h = 2h + G[byte]; by doubling the summed window."""
    h = _GEAR[raw]
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width].copy() << np.uint16(width)
        width *= 2
    return h


def chunks(raw: np.ndarray, offsets: np.ndarray, bits: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of each chunk of each text, in order; positions are in ``raw``.

    A chunk ends where the top ``bits`` bits of the hash are zero: 2**bits bytes on
    average. A cut depends on the ``WINDOW`` bytes before it alone, so a shift of
    the text moves the cuts with it. Chunks longer than ``most`` bytes are cut
    again, from their start. Empty texts have no chunk.
    """
    cut = (rolling(raw) >> np.uint16(WINDOW - bits)) == 0 if len(raw) else np.zeros(0, bool)
    sizes = np.diff(offsets)
    at = np.flatnonzero(cut) + 1
    doc = np.searchsorted(offsets, at - 1, side="right") - 1
    at = at[at - offsets[doc] >= WINDOW]  # elsewhere the window holds bytes of the text before
    ends = np.unique(np.concatenate((at, offsets[1:][sizes > 0])))
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else ends.astype(np.int64)
    if most is not None and len(ends) and (ends - starts).max() > most:
        parts = -(-(ends - starts) // most)
        which = np.repeat(np.arange(len(parts)), parts)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begins = starts[which] + nth * most
        starts, ends = begins, np.minimum(begins + most, ends[which])
    return np.searchsorted(offsets, starts, side="right") - 1, starts, ends
