"""Numpy passes over the UTF-8 bytes of many texts at once: words, shingles and windows as hashes.

A rolling hash of a byte range is a polynomial in an odd base modulo 2**64 over random byte values, taken as the difference of two
prefix sums and then mixed; equal ranges get equal hashes wherever they stand. Some texts (Thue-Morse sequences) collide in it by
construction, so it only says which ranges to compare; identities come from content_hashes or from the bytes.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
BASE = U(0x9E3779B97F4A7C15)
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
ORDER = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U(1)
#: The low n bytes of a block, and the longest range that is hashed block by block.
MASKS, LONG = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64), 256
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if len(_powers["up"]) < n:
        m = 1 << (n - 1).bit_length()
        for k, b in (("up", BASE), ("down", U(pow(int(BASE), -1, 2**64)))):
            x = np.full(m, b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_sums(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """s with s[i] = sum of the first i terms, len(data) + 1 long."""
    up, _ = powers(len(data))
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up, out=s[1:])
    return s


def range_hashes(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(s))
    return mix((s[end] - s[start]) * down[start] + (end - start).astype(np.uint64) * ORDER[63])


def content_hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each byte range, mixed block by block: unlike a polynomial's, their collisions are by chance
    alone, whatever the bytes. Ranges over LONG bytes go through xxh3_128."""
    eight = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))
    n = end - start
    a, b = mix(n.astype(np.uint64) + ORDER[62]), mix(n.astype(np.uint64) + ORDER[61])
    live = np.flatnonzero(n <= LONG)
    at, left = start[live], n[live]
    while len(live):
        block = eight[at] & MASKS[np.minimum(left, 8)]
        a[live], b[live] = mix(a[live] ^ block), mix(b[live] + block * ORDER[60])
        more = left > 8
        at, left, live = at[more] + 8, left[more] - 8, live[more]
    for i in np.flatnonzero(n > LONG):
        d = xxhash.xxh3_128_digest(data[start[i] : end[i]])
        a[i], b[i] = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little")
    return a, b


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word of all texts: index of its text, and two hashes with A-Z lower-cased."""
    joined = b"\n".join(texts) + b"\n"
    space = np.concatenate([[True], SPACE[np.frombuffer(joined, np.uint8)]])
    at = np.flatnonzero(space[1:] != space[:-1])
    start, end = at[0::2], at[1::2]
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    return np.searchsorted(offsets, start, "right") - 1, *content_hashes(joined.lower(), start, end)


def shingles(texts: list[bytes], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text two hashes of each of its k-word shingles, in order; a text of fewer words has its whole sequence as the only one."""
    doc, *lanes = words(texts)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    n = max(0, len(doc) - k + 1)
    full = [mix(sum((h[j : j + n] * ORDER[j] for j in range(k)), np.zeros(n, np.uint64))) for h in lanes]
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            out.append(tuple(f[a : b - k + 1] for f in full))
        elif b > a:
            out.append(tuple(mix((h[a:b] * ORDER[: b - a]).sum(keepdims=True) + ORDER[40 + b - a : 41 + b - a]) for h in lanes))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
    return out
