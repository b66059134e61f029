"""Vectorised word and sentence hashing over whole Arrow batches of text.

A *word* is a maximal run of ASCII letters, digits and underscores, or of
non-ASCII characters other than the Latin-1, general and CJK punctuation
blocks, after Unicode lower-casing.  A word is represented by a 64-bit hash of
its UTF-8 bytes, so that equal words have equal hashes on every machine.  No
Python object is made per word; a batch costs a fixed number of numpy passes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: dict[str, np.ndarray] = {}
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE ** i (or its inverse) modulo 2**64 for i < n, kept per worker."""
    key = "inverse" if inverse else "forward"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        step = int(BASE) if not inverse else pow(int(BASE), -1, 1 << 64)
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, step, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[key] = have
    return have[:n]


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each range; ranges may overlap."""
    if not len(start):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=total[1:])
    size = (end - start).astype(np.uint64)
    return mix((total[end] - total[start]) * powers(len(values) + 1, True)[start] + size * np.uint64(0xD6E8FEB86659FD93))


class Buffer(NamedTuple):
    """UTF-8 bytes of a batch of texts; text i is data[offsets[i]:offsets[i+1]]."""

    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Words of a batch: hash, byte range in the batch, and first word of each text."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray  # words of text i are bounds[i]:bounds[i+1]


def buffer(texts: pa.Array) -> Buffer:
    """The bytes of a string array without copying; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[: int(offsets[-1])] if raw is not None else np.zeros(0, np.uint8)
    return Buffer(data[int(offsets[0]) :], offsets - offsets[0])


def word_mask(data: np.ndarray) -> np.ndarray:
    """True where a byte belongs to a word."""
    mask = _WORD[data]
    for lead, second, width in ((0xC2, None, 2), (0xE2, 0x80, 3), (0xE3, 0x80, 3), (0xEF, 0xBC, 3)):
        at = np.flatnonzero(data == lead)
        at = at[at + width <= len(data)]
        if second is not None:
            at = at[data[at + 1] == second]
        else:  # Latin-1 punctuation; the feminine and masculine ordinals and the micro sign are letters
            at = at[~np.isin(data[at + 1], (0xAA, 0xB5, 0xBA))]
        for k in range(width):
            mask[at + k] = False
    return mask


def words(text: Buffer) -> Words:
    """All words of a batch of lower-cased texts, in order."""
    data, offsets = text
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64))
    mask = word_mask(data)
    edge = np.zeros(n + 1, bool)
    edge[1:n] = mask[1:] != mask[:-1]
    edge[offsets] = True  # words don't reach over the end of a text
    edge[0] = edge[n] = True
    cut = np.flatnonzero(edge)
    inside = mask[cut[:-1]]
    start, end = cut[:-1][inside], cut[1:][inside]
    return Words(range_hash(data.astype(np.uint64), start, end), start, end, np.searchsorted(start, offsets))


def lowered(texts: pa.Array) -> Buffer:
    """The bytes of the lower-cased texts. Lengths in bytes may differ from the original."""
    return buffer(pc.utf8_lower(pc.fill_null(texts, "")))


def slices(n: int, sizes: np.ndarray, limit: int = 4 << 20) -> list[tuple[int, int]]:
    """Ranges of consecutive rows with about limit bytes each; a longer row stands alone."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    out, at = [], 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
        out.append((at, min(to, n)))
        at = out[-1][1]
    return out
