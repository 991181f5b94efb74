"""Word positions and hashes of many texts at once, in numpy, for use inside Arrow tasks."""

from __future__ import annotations

import numpy as np

#: ASCII white space, bytes 9 to 13 and 32.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CODES = np.random.default_rng(20240601).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            x = np.full(max(n, 1 << 20), b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def packed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as UTF-8 in one buffer with a newline after each, and where each begins (one more at the end)."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return np.frombuffer(b"\n".join(raw) + b"\n" if raw else b"", np.uint8), offsets


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer."""
    inside = ~SPACES[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes that does not depend on where it stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # buffers of any size, in pieces that stay in cache
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + (1 << 20))))
        lo, hi = int(starts[at]), int(ends[to - 1])
        up, down = powers(hi - lo)
        values = _CODES[data[lo:hi]]
        values *= up
        values[SPACES[data[lo:hi]]] = 0
        out[at:to] = np.add.reduceat(values, starts[at:to] - lo) * down[starts[at:to] - lo]
        at = to
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def per_text(starts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each text (one more at the end), and the text of each word."""
    first = np.searchsorted(starts, offsets)
    return first, np.repeat(np.arange(len(offsets) - 1), np.diff(first))
