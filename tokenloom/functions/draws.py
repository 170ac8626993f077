"""The first numbers of many of Python's random sources at once."""

from __future__ import annotations

from functools import cache
from hashlib import sha512

import numpy as np

N, M = 624, 397


@cache
def _start() -> tuple[int, ...]:
    out = [19650218]
    for i in range(1, N):
        out.append((1812433253 * (out[-1] ^ out[-1] >> 30) + i) & 0xFFFFFFFF)
    return tuple(out)


def first_draws(seeds: list[bytes], many: int) -> np.ndarray:
    """Of each seed the first numbers that random.Random(seed as text).random() gives, as (many, seeds).

    Seeds are not empty and begin with no NUL; many is at most 100.
    """
    out = np.empty((many, len(seeds)))
    sizes = np.array([len(s) for s in seeds])
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        keys = np.frombuffer(b"".join(s + sha512(s).digest() for i in at.tolist() for s in (seeds[i],)), np.uint8).reshape(len(at), -1)
        padded = np.zeros((len(at), -(-keys.shape[1] // 4) * 4), np.uint8)
        padded[:, : keys.shape[1]] = keys[:, ::-1]
        out[:, at] = _drawn(np.ascontiguousarray(padded.view("<u4").astype(np.uint32).T), many)
    return out


def _drawn(key: np.ndarray, many: int) -> np.ndarray:
    """From keys of 32 bits, least first: MT19937 set by them, its first numbers alone."""
    key = key + np.arange(len(key), dtype=np.uint32)[:, None]
    start = _start()
    state = np.empty((N, key.shape[1]), np.uint32)
    state[0] = start[0]
    mixed = np.empty(key.shape[1], np.uint32)

    def mix(before: np.ndarray, factor: int) -> np.ndarray:
        np.right_shift(before, np.uint32(30), out=mixed)
        np.bitwise_xor(mixed, before, out=mixed)
        return np.multiply(mixed, np.uint32(factor), out=mixed)

    for k in range(N):  # goes round once, and place 1 comes twice
        i = k + 1 if k < N - 1 else 1
        before = state[i - 1] if k < N - 1 else state[N - 1]
        np.bitwise_xor(mix(before, 1664525), np.uint32(start[i]) if k < N - 1 else state[1], out=mixed)
        np.add(mixed, key[k % len(key)], out=state[i])
    for k in range(N - 1):
        i = k + 2 if k < N - 2 else 1
        before = state[i - 1] if k < N - 2 else state[N - 1]
        np.bitwise_xor(mix(before, 1566083941), state[i], out=mixed)
        np.subtract(mixed, np.uint32(i), out=state[i])
    state[0] = 0x80000000
    n = 2 * many
    y = (state[:n] & np.uint32(0x80000000)) | (state[1 : n + 1] & np.uint32(0x7FFFFFFF))
    x = state[M : M + n] ^ (y >> np.uint32(1)) ^ (y & np.uint32(1)) * np.uint32(0x9908B0DF)
    x ^= x >> np.uint32(11)
    x ^= (x << np.uint32(7)) & np.uint32(0x9D2C5680)
    x ^= (x << np.uint32(15)) & np.uint32(0xEFC60000)
    x ^= x >> np.uint32(18)
    return ((x[::2] >> np.uint32(5)) * 67108864.0 + (x[1::2] >> np.uint32(6))) / 9007199254740992.0
