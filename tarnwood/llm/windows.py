"""Windows of W consecutive symbols (bytes or words) that also start in an earlier document: the part that substring
operators share.

Every window is assigned to its anchor, the k-gram of least hash among those inside it (the leftmost on a tie). The
choice depends on the window's content alone, so equal windows have equal anchors at equal offsets. Consecutive windows
with one anchor form a piece, at most W - k + 1 windows. Two windows can only be equal if their pieces share the anchor."""

from __future__ import annotations

import numpy as np

from .common import mix64

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
#: Keys that are compared hold a place in the low bits, so the leftmost of grams with equal high bits is taken; any
#: number of symbols below 2**32 is cut alike.
_BITS = 32
BYTE = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLD)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(max(n, 1 << 20), base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k symbols from each place on; symbols are 64-bit hashes themselves. Shorter than k: empty."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power(len(symbols) + 1)
    prefix = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[: len(symbols)], out=prefix[1:])
    return mix64((prefix[k:] - prefix[:-k]) * down[:n])


def pieces(symbols: np.ndarray, ends: np.ndarray, width: int, k: int):
    """For texts given by n + 1 offsets: arrays row, first window, number of windows, anchor hash, anchor place."""
    empty = np.zeros(0, np.int64)
    n, span = len(symbols), width - k + 1
    if n < width:
        return empty, empty, empty, empty.view(np.uint64), empty
    if n >= 1 << _BITS:
        raise ValueError("too many symbols at a time")
    full = gram_hashes(symbols, k)
    low = np.uint64((1 << _BITS) - 1)
    least = (full & ~low) | np.arange(len(full), dtype=np.uint64)
    size = 1
    while 2 * size <= span:  # least of the `size` grams from each place on
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    if size < span:
        rest = span - size
        least = np.minimum(least[: len(least) - rest], least[rest:])
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + width <= ends[1:][row])
    at, row = (least[start] & low).astype(np.int64), row[start]
    if not len(start):
        return empty, empty, empty, empty.view(np.uint64), empty
    head = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    count = np.diff(np.append(head, len(start)))
    return row[head], start[head], count, full[at[head]], at[head]


def word_symbols(raw: np.ndarray, ends: np.ndarray):
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of each text; n + 1 offsets in words; byte start and end of each word."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.zeros(len(raw) + 1, bool)
    edge[ends] = True
    inside = ~space
    start = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], space[:-1]]))) if len(raw) else np.zeros(0, np.int64)
    stop = np.flatnonzero(inside & (edge[1:] | np.concatenate([space[1:], [True]]))) + 1 if len(raw) else np.zeros(0, np.int64)
    up, down = _power(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE[raw] * up[: len(raw)], out=prefix[1:])
    return mix64(((prefix[stop] - prefix[start]) * down[start]) ^ ((stop - start).astype(np.uint64) * _GOLD)), np.searchsorted(start, ends), start, stop
