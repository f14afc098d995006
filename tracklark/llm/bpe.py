"""Byte-level BPE by prefix dynamic programming.

For each byte prefix of a piece there is exactly one token that can be the last of the prefix's encoding: the one that is
compatible with the last token of the prefix it leaves. So a table of last tokens is enough to read off the encoding of any
prefix, bytes can be appended without touching what stands, and an edit only recomputes what follows it.

Two tokens are compatible if encoding their joined bytes gives just these two: no merge across their border may come up
before the tokens next to the border have grown into the two.
"""

from __future__ import annotations

import base64

import ahocorasick
import regex

from tracklark.llm.common import Cache

#: Above all ranks.
NEVER = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def splitter(pattern: str) -> regex.Pattern:
    """The pattern with white space as Unicode defines it, whatever this library takes for it."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class PrefixEncoder:
    """Encodes pieces (byte strings) by the ranks of their tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        # Finds all tokens that end at a place, longest first; bytes stand for themselves as characters.
        self.finder = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.finder.add_word(token.decode("latin-1"), (rank, len(token)))
        self.finder.make_automaton()
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.edges: dict[tuple[bytes, bool], list[tuple[bytes, int]]] = {}
        self.pairs = Cache(1_000_000)

    def merged(self, data: bytes, below: int) -> list[bytes]:
        """data after all merges of a rank under below, lowest first, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while True:
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1], below)) < below]
            if not found:
                return parts
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens that merge into this one; None for one that never comes of merges."""
        if token not in self.halves:
            parts = self.merged(token, self.ranks[token])
            self.halves[token] = tuple(parts) if len(parts) == 2 else None
        return self.halves[token]

    def edge(self, token: bytes, right: bool) -> list[tuple[bytes, int]]:
        """What stands at the token's right (left) border while it grows, each with the rank of the merge that ends it."""
        key = (token, right)
        if key not in self.edges:
            if len(token) > 1 and (two := self.split(token)):
                part = two[right]
                inner = self.edge(part, right)
                self.edges[key] = [*inner[:-1], (inner[-1][0], self.ranks[token]), (token, NEVER)]
            else:
                self.edges[key] = [(token, NEVER)]
        return self.edges[key]

    def compatible(self, left: int, right: int) -> bool:
        a, b = self.edge(self.tokens[left], True), self.edge(self.tokens[right], False)
        i = j = 0
        while True:
            (x, ends_x), (y, ends_y) = a[i], b[j]
            across = self.ranks.get(x + y, NEVER)
            # At equal ranks the leftmost merge comes first.
            if across < ends_x and across <= ends_y and across < NEVER:
                return False
            if ends_x == ends_y == NEVER:
                return True
            if ends_x <= ends_y:
                i += 1
            else:
                j += 1

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """The table of data (the rank of each prefix's last token), where last already is that of its first len(last) bytes;
        it is extended in place."""
        pairs, done = self.pairs, len(last)
        start = max(0, done - self.longest + 1)
        for at, (rank, size) in self.finder.iter(data[start:].decode("latin-1")):
            if (end := at + start) == done:
                left = end + 1 - size
                if left:
                    key = last[left - 1] << 32 | rank
                    fits = pairs.get(key)
                    if fits is None:
                        pairs.room(1)
                        fits = pairs[key] = self.compatible(last[left - 1], rank)
                else:
                    fits = size == 1 or self.split(self.tokens[rank])
                if fits:
                    last.append(rank)
                    done += 1
        if done < len(data):
            raise ValueError(f"no token ends at byte {done + 1}")
        return last

    def read(self, last: list[int]) -> list[int]:
        """The encoding that a table stands for."""
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.tokens[last[at - 1]])
        return out[::-1]

    def append(self, data: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """data and its table with more at the end; no entry of the old table changes."""
        data += more
        return data, self.extend(data, last)

    def edit(self, data: bytes, last: list[int], start: int, end: int, put: bytes) -> tuple[bytes, list[int]]:
        """data[start:end] replaced by put. Entries before start stay. Behind the edit, once as many entries in a row as the
        longest token has bytes agree with the old ones, all later ones agree too and are taken over."""
        new, table, shift = data[:start] + put + data[end:], last[:start], len(put) - (end - start)
        same, at = 0, start
        while at < len(new):
            at += 1
            self.extend(new[:at], table)
            behind = at - start - len(put)
            same = same + 1 if behind > 0 and last[at - shift - 1] == table[-1] else 0
            if same >= self.longest:
                return new, table + last[at - shift :]
        return new, table

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        return self.read(self.extend(piece, []))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


class PieceEncoder:
    """value(piece) for the pieces of whole texts, each worked out once while it stays in the cache."""

    def __init__(self, pattern: str, value, most: int = 400_000):
        self.pattern, self.value, self.known = splitter(pattern), value, Cache(most)

    def of_text(self, text: str) -> list:
        pieces, known = self.pattern.findall(text), self.known
        out = [known.get(x) for x in pieces]
        if None in out:
            known.room(len(out))
            for i, v in enumerate(out):
                if v is None:
                    x = pieces[i]
                    v = out[i] = known.get(x) or self.value(x)
                    known[x] = v
        return out
