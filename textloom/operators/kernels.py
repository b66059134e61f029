"""Splitting and merging of one text: the sequential parts that every chunker shares.

Choices where nothing is laid down: of several delimiters that fit at a place the
longest is taken; pieces are merged while their sum is at most the size, and a
piece above the size stands alone; pieces below the least length take in the
next one, the last may stay short.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

import numpy as np

from textloom.operators.base import Piece


@functools.lru_cache(256)
def _finder(delimiters: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(re.escape(d) for d in sorted(delimiters, key=len, reverse=True)))


def split_text(text: str, delimiters: Sequence[str], include: str | None = "prev", min_chars: int = 1) -> list[str]:
    """text cut after ("prev") or before ("next") every delimiter, or at it with the delimiter dropped (None)."""
    if not delimiters:
        return [text] if text else []
    pieces, at = [], 0
    for m in _finder(tuple(delimiters)).finditer(text):
        cut, to = {"prev": (m.end(), m.end()), "next": (m.start(), m.start()), None: (m.start(), m.end())}[include]
        if cut > at:
            pieces.append(text[at:cut])
        at = to
    if at < len(text):
        pieces.append(text[at:])
    if min_chars <= 1:
        return pieces
    out, now = [], ""
    for p in pieces:
        now += p
        if len(now) >= min_chars:
            out.append(now)
            now = ""
    return [*out, now] if now else out


def split_pattern(text: str, pattern: str, mode: str = "split", include: str | None = "prev") -> list[str]:
    """text cut at the matches of a regular expression, or the matches alone (mode "extract")."""
    found = list(re.finditer(pattern, text))
    if mode == "extract":
        return [m.group(0) for m in found if m.group(0)]
    out, at = [], 0
    for m in found:
        cut, to = {"prev": (m.end(), m.end()), "next": (m.start(), m.start()), None: (m.start(), m.end())}[include]
        if cut > at:
            out.append(text[at:cut])
        at = max(at, to)
    if at < len(text):
        out.append(text[at:])
    return out


def groups(counts: Sequence[int], size: int) -> list[tuple[int, int]]:
    """Ranges of consecutive pieces whose counts sum to at most size, at least one piece each."""
    out, start, total = [], 0, 0
    for i, n in enumerate(counts):
        if i > start and total + n > size:
            out.append((start, i))
            start, total = i, 0
        total += n
    if start < len(counts):
        out.append((start, len(counts)))
    return out


def merged(pieces: Sequence[str], counts: Sequence[int], size: int, joiner: str = "") -> list[tuple[str, int]]:
    """Pieces merged into groups(); if all are above size, they are left as they are."""
    if all(n > size for n in counts):
        return list(zip(pieces, counts, strict=True))
    return [(joiner.join(pieces[a:z]), sum(counts[a:z])) for a, z in groups(counts, size)]


def placed(parts: Sequence[tuple[str, int]], start: int = 0) -> list[Piece]:
    """Pieces that follow each other, with their places."""
    out = []
    for text, n in parts:
        out.append((text, start, start + len(text), n))
        start += len(text)
    return out


@functools.cache
def smoothing(window: int, order: int, derivative: int) -> np.ndarray:
    """Savitzky-Golay coefficients for the middle of a window: least squares of a polynomial, its derivative at 0."""
    half = window // 2
    x = np.arange(-half, half + 1, dtype=float)
    powers = np.vander(x, order + 1, increasing=True)
    weights = np.linalg.pinv(powers)
    factor = float(np.prod(np.arange(1, derivative + 1))) if derivative else 1.0
    return weights[derivative] * factor if derivative <= order else np.zeros(window)


def window_similarity(vectors: np.ndarray, window: int) -> np.ndarray:
    """For every gap between neighbouring vectors, the mean cosine of those before it and after it within an odd window."""
    if window < 3 or not window % 2:
        raise ValueError("the window is odd and at least 3")
    x = np.asarray(vectors, float)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
    half, total = window // 2, np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)])
    gap = np.arange(1, len(x))
    low, high = np.maximum(gap - half, 0), np.minimum(gap + half, len(x))
    # the mean over all pairs is the product of the sums
    return ((total[gap] - total[low]) * (total[high] - total[gap])).sum(axis=1) / ((gap - low) * (high - gap))


def local_minima(values: np.ndarray, window: int = 5, order: int = 3, tolerance: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """Places and smoothed values where the smoothed first derivative is within tolerance of 0 and the second is positive.

    The ends are extended by their values. Of neighbouring places the one of
    the least value stands.
    """
    half = window // 2
    padded = np.pad(np.asarray(values, float), half, mode="edge")
    smooth, slope, bend = (np.convolve(padded, smoothing(window, order, d)[::-1], "valid") for d in (0, 1, 2))
    at = np.flatnonzero((np.abs(slope) < tolerance) & (bend > 0))
    keep = []
    for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []:
        keep.append(run[np.argmin(smooth[run])])
    keep = np.array(keep, int)
    return keep, smooth[keep]


def chosen_minima(at: np.ndarray, values: np.ndarray, threshold: float, distance: int) -> list[int]:
    """Of the minima those at or below the threshold quantile of their values, at least distance apart, in order."""
    if not len(at):
        return []
    limit = np.quantile(values, min(max(threshold, 0.0), 1.0))
    out: list[int] = []
    for i, v in zip(at.tolist(), values.tolist(), strict=True):
        if v <= limit and (not out or i - out[-1] >= distance):
            out.append(i)
    return out
