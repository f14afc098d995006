"""Splits whole texts into the pieces of the byte-level pattern by numpy, and names each piece by a 64-bit hash; differ()
tells which pieces are not the ones that they share a name with.

The pattern's rules, as tests on neighbouring characters: a piece is a run of letters, of numbers, of other marks or of white
space; one plain space before a run belongs to it; the last character of a white-space run before something else stands apart.
Texts with an apostrophe (contractions) or a special string go through the pattern itself.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np

from tracklark.llm.textnum import MASKS, content_hashes

LETTER, NUMBER, SPACE, WHITE, MARK = range(5)
_classes: list[np.ndarray] = []


def matching(pattern: str, points: list[int]) -> list[int]:
    """Of these code points those that the tokenizers' own engine takes for this class."""
    from tokenizers import Regex, pre_tokenizers

    text = "\0".join(map(chr, points))  # the mark keeps matches apart
    return [points[a // 2] for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "isolated").pre_tokenize_str(text) if b - a == 1 and a % 2 == 0]


def classes() -> np.ndarray:
    """The class of each code point. What this Python does not know yet, the tokenizers' own engine is asked for; planes 4 to 13
    hold no characters."""
    if not _classes:
        table = np.full(sys.maxunicode + 1, MARK, np.uint8)
        new = []
        for c in (*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000)):
            kind = unicodedata.category(chr(c))
            if kind[0] in "LN":
                table[c] = LETTER if kind[0] == "L" else NUMBER
            elif kind == "Cn":
                new.append(c)
        for kind, pattern, points in ((LETTER, r"\p{L}", new), (NUMBER, r"\p{N}", new), (WHITE, r"\s", list(range(0x3001)))):
            table[matching(pattern, points)] = kind
        table[0x20] = SPACE
        _classes.append(table)
    return _classes[0]


def split(texts: list[str], pattern) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts' joined bytes, the byte offset of each piece (and the end), and the first piece of each text (and their number)."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = classes()[points] if len(points) else np.zeros(0, np.uint8)
    white = (kind == SPACE) | (kind == WHITE)
    lengths = np.array([len(t) for t in texts])
    first = np.concatenate([[0], np.cumsum(lengths)])
    n = len(points)
    start = np.zeros(n + 1, bool)
    if n:
        head = np.zeros(n + 1, bool)
        head[first] = True
        same = np.zeros(n, bool)
        same[1:] = (kind[1:] == kind[:-1]) | (white[1:] & white[:-1])
        run = head[:n] | ~same  # starts of runs
        ends = np.append(run[1:], True) | head[1:]  # last characters of runs
        # The last white character before something else of the same text stands apart.
        apart = white & ends & ~head[1:]
        start[:n] = run | apart
        # A run after a plain space begins there.
        joined_on = np.zeros(n, bool)
        joined_on[1:] = apart[:-1] & (kind[:-1] == SPACE) & ~white[1:] & ~head[1:n]
        start[:n] &= ~joined_on
        for i, t in enumerate(texts):
            if "'" in t:
                a, b = first[i], first[i + 1]
                start[a:b] = False
                start[[a + m.start() for m in pattern.finditer(t)]] = True
    start[n] = True
    data = joined.encode()
    at = np.flatnonzero(start)
    width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    offsets = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
    return data, offsets[at], np.searchsorted(at, first)


def named(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """A hash for each piece."""
    return content_hashes(data, offsets[:-1], offsets[1:])[0]


def differ(data: bytes, offsets: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The pieces whose bytes are not those of the piece in other."""
    eight = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))
    a, b, n = offsets[:-1], offsets[other], np.diff(offsets)
    wrong = n != offsets[other + 1] - b
    live = np.flatnonzero(~wrong)
    step = 0
    while len(live):
        mask = MASKS[np.minimum(n[live] - step, 8)]
        unlike = (eight[a[live] + step] ^ eight[b[live] + step]) & mask != 0
        wrong[live[unlike]] = True
        step += 8
        live = live[~unlike & (n[live] > step)]
        if step == 64:  # the few long ones
            wrong[[i for i in live if data[a[i] : a[i] + n[i]] != data[b[i] : b[i] + n[i]]]] = True
            break
    return np.flatnonzero(wrong)
