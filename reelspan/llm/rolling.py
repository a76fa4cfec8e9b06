"""Hashes of all substrings of a byte string in constant time each, by numpy.

Bytes are mapped to random 64-bit values v; with G the running sum of v[j] * Q**j modulo 2**64, the hash of [a, b) is
(G[b] - G[a]) * Q**-a, mixed. Q is odd and so has an inverse. Equal substrings have equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np

_Q = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_QINV = pow(_Q, -1, 1 << 64)
_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Q**j and Q**-j for j up to ``n`` at least."""
    if not _powers or len(_powers["q"]) <= n:
        size = max(1 << 16, n + n // 8)
        for name, base in (("q", _Q), ("i", _QINV)):
            out, have = np.empty(size + 1, np.uint64), 1
            out[0] = 1
            while have <= size:
                more = min(have, size + 1 - have)
                out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
                have += more
            _powers[name] = out
    return _powers["q"], _powers["i"]


def running(raw: np.ndarray) -> np.ndarray:
    """G, one longer than ``raw``."""
    q, _ = powers(len(raw))
    out = np.zeros(len(raw) + 1, np.uint64)
    terms = np.take(_VALUES, raw)
    terms *= q[: len(raw)]
    np.cumsum(terms, out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def hashes(total: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, i = powers(len(total))
    return mix((total[ends] - total[begins]) * i[begins])


def widths(total: np.ndarray, width: int) -> np.ndarray:
    """The hashes of all substrings of ``width`` bytes, as ``hashes`` gives them."""
    _, i = powers(len(total))
    h = total[width:] - total[:-width]
    h *= i[: len(h)]
    return mix(h)
