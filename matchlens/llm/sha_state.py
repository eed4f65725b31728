"""SHA-256 whose state can be kept and resumed: one state a row, whole columns at a time.

A state is what the hash has after some whole blocks of 64 bytes: eight words. The hex text of a digest is just one block, so a
state before each child of a tree node is a state between blocks. Library hashes can be copied inside a process, but not stored.
"""

from __future__ import annotations

from math import isqrt

import numpy as np

_U = np.uint32


def _primes(n: int) -> list[int]:
    found: list[int] = []
    x = 2
    while len(found) < n:
        if all(x % p for p in found if p * p <= x):
            found.append(x)
        x += 1
    return found


def _cube_root(x: int) -> int:
    r = round(x ** (1 / 3))
    while r**3 > x:
        r -= 1
    while (r + 1) ** 3 <= x:
        r += 1
    return r


#: The standard's constants by its own rule: leading 32 bits of the fractions of square and cube roots of the first primes.
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], _U)
_K = [_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)]


def start(n: int) -> np.ndarray:
    """n fresh states: (8, n) words."""
    return np.repeat(START[:, None], n, axis=1)


def _turn(x: np.ndarray, by: int, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    np.right_shift(x, _U(by), out=out)
    np.left_shift(x, _U(32 - by), out=spare)
    return np.bitwise_or(out, spare, out=out)


def absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The (8, n) states after one more block: (16, n) words, or (16, 1) for the same block in all."""
    n = state.shape[1]
    a, b, c, d, e, f, g, h = (state[i].copy() for i in range(8))
    w = [block[i] for i in range(16)]
    s, t, u = np.empty(n, _U), np.empty(n, _U), np.empty(n, _U)
    for i in range(64):
        if i >= 16:
            x, y = w[i - 15], w[i - 2]
            p, q, r = np.empty_like(x), np.empty_like(x), np.empty_like(x)
            new = w[i - 16] + w[i - 7]
            new += _turn(x, 7, p, r) ^ _turn(x, 18, q, r) ^ (x >> _U(3))
            new += _turn(y, 17, p, r) ^ _turn(y, 19, q, r) ^ (y >> _U(10))
            w.append(new)
        # h takes the first sum, then becomes the next round's a
        h += _turn(e, 6, s, u)
        h -= s
        _turn(e, 11, t, u)
        s ^= t
        _turn(e, 25, t, u)
        s ^= t
        h += s
        np.bitwise_xor(f, g, out=s)
        s &= e
        s ^= g
        h += s
        h += w[i] + _U(_K[i])
        d += h
        _turn(a, 2, s, u)
        _turn(a, 13, t, u)
        s ^= t
        _turn(a, 22, t, u)
        s ^= t
        h += s
        np.bitwise_and(a, b, out=s)
        np.bitwise_xor(a, b, out=t)
        t &= c
        s ^= t
        h += s
        a, b, c, d, e, f, g, h = h, a, b, c, d, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def closed(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The digests, (8, n) words, of states that have taken whole blocks; blocks: how many each has taken."""
    out = np.empty_like(state)
    for k in np.unique(blocks):
        at = np.flatnonzero(blocks == k)
        last = np.zeros((16, 1), _U)
        last[0], last[14], last[15] = _U(0x80000000), _U((int(k) * 512) >> 32), _U((int(k) * 512) & 0xFFFFFFFF)
        out[:, at] = absorb(state[:, at], last)
    return out


_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def hex_text(words: np.ndarray) -> np.ndarray:
    """(8, n) words -> (n, 64) bytes of hex text."""
    raw = np.ascontiguousarray(words.T.astype(">u4")).view(np.uint8).reshape(-1, 32)
    out = np.empty((len(raw), 64), np.uint8)
    out[:, 0::2], out[:, 1::2] = _HEX[raw >> 4], _HEX[raw & 15]
    return out


def block_of(text: np.ndarray) -> np.ndarray:
    """(n, 64) bytes -> (16, n) words."""
    return np.ascontiguousarray(np.ascontiguousarray(text).view(">u4").astype(_U).T)


def from_bytes(raw: bytes) -> np.ndarray:
    """32-byte digests or states one after the other -> (8, n) words."""
    return np.ascontiguousarray(np.frombuffer(raw, ">u4").reshape(-1, 8).T.astype(_U))


def to_bytes(words: np.ndarray) -> list[bytes]:
    raw = np.ascontiguousarray(words.T.astype(">u4")).tobytes()
    return [raw[i : i + 32] for i in range(0, len(raw), 32)]
