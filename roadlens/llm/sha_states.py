"""SHA-256 with states that can be kept, moved and resumed, many at a time (numpy).

``hashlib`` can copy a state inside a process only; a manifest tree keeps its states in tables,
so that another task may resume them.  A state is eight 32-bit words.  The constants are those
of the standard: the first 32 bits of the fractions of square and cube roots of the primes.
"""

from __future__ import annotations

import math

import numpy as np

PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, p))]


def _cube_root(n: int) -> int:
    r = round(n ** (1 / 3))
    while r ** 3 > n:
        r -= 1
    while (r + 1) ** 3 <= n:
        r += 1
    return r


START = np.array([math.isqrt(p << 64) & 0xFFFFFFFF for p in PRIMES[:8]], np.uint32)
ROUNDS = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in PRIMES], np.uint32)
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)
LANES = 8192


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _absorbed(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    w = [block[:, k] for k in range(16)]
    for t in range(16, 64):
        a, b = w[t - 15], w[t - 2]
        w.append(w[t - 16] + (_turn(a, 7) ^ _turn(a, 18) ^ (a >> np.uint32(3))) + w[t - 7]
                 + (_turn(b, 17) ^ _turn(b, 19) ^ (b >> np.uint32(10))))
    a, b, c, d, e, f, g, h = (state[:, k] for k in range(8))
    for t in range(64):
        x = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUNDS[t] + w[t]
        y = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = x + y, a, b, c, d + x, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h], 1)


def absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (n, 8) after one block of 16 words (n, 16) each."""
    if len(state) <= LANES:
        return _absorbed(state, block)
    return np.concatenate([_absorbed(state[k:k + LANES], block[k:k + LANES]) for k in range(0, len(state), LANES)])


def hex_text(digests: np.ndarray) -> np.ndarray:
    """Digests (n, 32) of bytes as lowercase hex (n, 64) of bytes."""
    out = np.empty((len(digests), 64), np.uint8)
    out[:, 0::2] = HEX[digests >> 4]
    out[:, 1::2] = HEX[digests & 15]
    return out


def hex_block(digests: np.ndarray) -> np.ndarray:
    """The hex text of a digest is just one block: its 16 words."""
    return hex_text(digests).view(">u4").astype(np.uint32)


def closed(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (n, 32): the states after ``blocks`` whole blocks each, ended as the standard says."""
    last = np.zeros((len(state), 16), np.uint32)
    last[:, 0] = 0x80000000
    last[:, 15] = blocks * 512
    return absorb(state, last).astype(">u4").view(np.uint8).reshape(-1, 32)


def packed(state: np.ndarray) -> np.ndarray:
    """States (..., 8) as bytes (..., 32)."""
    return np.ascontiguousarray(state, ">u4").view(np.uint8)


def unpacked(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data).view(">u4").astype(np.uint32)
