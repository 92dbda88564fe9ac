"""Content-chosen anchors: a short way to see which parts of texts can repeat at all.

Every window of WIDTH bytes picks the leftmost least of the hashes of its GRAM-byte strings, its
anchor. The choice depends on the window's bytes alone, so equal windows have equal anchors at
equal places. The windows that share one anchor place lie side by side; together they span a
context, a stretch of WIDTH to about 2 * WIDTH bytes."""

from __future__ import annotations

import numpy as np

WIDTH, GRAM = 200, 40
#: Longer texts are treated in blocks; windows that start in different blocks have different contexts.
BLOCK = 1 << 19
_U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _U64(0xD1B54A32D192ED03))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2 to the 64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 14)
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[k] = np.cumprod(out)
    return _powers[0][:n], _powers[1][:n]


def contexts(data: bytes) -> tuple[np.ndarray, ...]:
    """gram, context (64-bit hashes), first, last (starts of the context's first and last window)
    and place (of the gram) of every anchor of the data; nothing if it is shorter than WIDTH."""
    parts = [_block(data, at) for at in range(0, max(1, len(data) - WIDTH + 1), BLOCK)]
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(5))


def _block(data: bytes, at: int) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(data, np.uint8)[at : at + BLOCK + WIDTH - 1]
    n = len(raw)
    if n < WIDTH:
        return *(np.empty(0, np.uint64) for _ in range(2)), *(np.empty(0, np.int64) for _ in range(3))
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[raw] * up[:n], out=sums[1:])
    grams = _mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    # hash above, place below: the least is the leftmost least
    least = (grams & _U64(~((1 << 20) - 1) & _MASK)) | np.arange(len(grams), dtype=np.uint64)
    width, have = WIDTH - GRAM + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    if width > have:
        step = width - have
        least = np.minimum(least[: len(least) - step], least[step:])
    place = (least & _U64((1 << 20) - 1)).astype(np.int64)
    turn = np.flatnonzero(np.diff(place)) + 1
    first, last = np.concatenate([[0], turn]), np.concatenate([turn - 1, [len(place) - 1]])
    context = _mix((sums[last + WIDTH] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    return grams[place[first]], context, first + at, last + at, place[first] + at
