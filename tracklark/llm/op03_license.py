"""License scans by patience alignment of a text's words with each template's.

Words that occur once in both are anchors; the longest increasing subsequence of their places is kept, and the gaps between kept
anchors are aligned in the same way, until a gap has no common unique word; such a gap is aligned by its longest common subsequence,
halved again and again, so memory is linear in its length. Coverage is the share of a template's words that this alignment matches
inside the best window of the text, and the matched words are the place; nothing else decides. Windows begin in every
1/32 of a template's length (at every word for templates below 64 words) and are 5/4 and 3 times as long as it: the narrow ones
hold one copy only, so that words of another copy or of the prose around are no anchors; the wide ones, for copies with words put in,
are judged where no narrow one reaches the threshold. A copy spread over more than that is not found.

A window is only aligned if enough of the template's words occur in it, as often as in the template, which bounds the coverage
from above, so nothing that could reach the threshold is skipped.

Defined results: a null or empty text has no licence; equal coverage goes to the longer template, then to the first by name; of windows
with equal coverage the shortest place counts, then the first; repeated rows are scanned alike; an empty table gives an empty table; columns beside doc_id and text do not matter.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession

from tracklark.llm.common import documents, id_and_text, per_batch

# Notices and grants of well-known licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Released under the MIT License",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
TOKEN = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
#: Words of a window for each word of the template, and the windows that begin within a template's length.
STRETCHES, STARTS = (1.25, 3.0), 32


def increasing(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience piles."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        before[i] = at[k - 1] if k else -1
        tops[k : k + 1] = [p]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def common_lengths(words: list[str], template: list[str]) -> list[int]:
    """Length of the longest common subsequence of words and the template up to each of its places, 0 included (bits stand for its words)."""
    masks: dict[str, int] = defaultdict(int)
    for j, w in enumerate(template):
        masks[w] |= 1 << j
    full = open_ = (1 << len(template)) - 1
    for w in words:
        hit = open_ & masks.get(w, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    bits = bin(open_ | 1 << len(template))[:2:-1]
    return [0, *accumulate(int(x == "0") for x in bits)]


def subsequence(a: list[str], a0: int, a1: int, b: list[str], b0: int, b1: int) -> list[tuple[int, int]]:
    """Matched places of a longest common subsequence of a[a0:a1] and b[b0:b1]: a is halved, b is cut where both halves match most."""
    out, open_ = [], [(a0, a1, b0, b1)]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        if a1 - a0 == 1:
            j = next((j for j in range(b0, b1) if b[j] == a[a0]), None)
            if j is not None:
                out.append((a0, j))
        elif a1 > a0 and b1 > b0:
            m = (a0 + a1) // 2
            left, right = common_lengths(a[a0:m], b[b0:b1]), common_lengths(a[m:a1][::-1], b[b0:b1][::-1])
            cut = max(range(len(left)), key=lambda k: left[k] + right[-1 - k])
            if left[cut]:
                open_.append((a0, m, b0, b0 + cut))
            if right[-1 - cut]:
                open_.append((m, a1, b0 + cut, b1))
    return out


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (i in a, j in b), increasing in both."""
    out, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        # Equal words at the ends need no anchor.
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        of_a = {a[i]: i for i in range(a0, a1) if in_a[a[i]] == 1}
        anchors = [(of_a[b[j]], j) for j in range(b0, b1) if in_b[b[j]] == 1 and b[j] in of_a]
        kept = [anchors[k] for k in increasing([i for i, _ in anchors])]
        if not kept:
            out += subsequence(a, a0, a1, b, b0, b1)
            continue
        out += kept
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *kept], [*kept, (a1, b1)], strict=True):
            if i + 1 < k and j + 1 < m:
                gaps.append((i + 1, k, j + 1, m))
    return sorted(out)


def windows(at: list[int], words: list[str], template: list[str], width: int) -> Iterator[tuple[int, int, int]]:
    """Of the template's words in a text (their places and themselves): range of those in the width words from each one on, and
    how many of the template's words they can match at most."""
    wanted, seen = Counter(template), Counter()
    bound = b = 0
    for a, start in enumerate(at):
        while b < len(at) and at[b] < start + width:
            seen[words[b]] += 1
            bound += seen[words[b]] <= wanted[words[b]]
            b += 1
        yield a, b, bound
        bound -= seen[words[a]] <= wanted[words[a]]
        seen[words[a]] -= 1


def best_window(at: list[int], words: list[str], template: list[str], least: float) -> tuple[int, int, int]:
    """Aligned words, first and last of them (end exclusive) in the best window; zeros if none has this coverage."""
    best, cell = (0, 0, 0), max(1, len(template) // STARTS)
    for stretch in STRETCHES:
        for a, b, bound in windows(at, words, template, int(stretch * len(template))):
            inside = a and at[a] // cell == at[a - 1] // cell
            if inside or bound < best[0] or bound < least * len(template):
                continue
            pairs = align(words[a:b], template)
            n = len(pairs)
            if n < max(best[0], least * len(template), 1):
                continue
            start, end = at[a + pairs[0][0]], at[a + pairs[-1][0]] + 1
            if n > best[0] or (end - start, start) < (best[2] - best[1], best[1]):
                best = n, start, end
            if end - start == len(template) == n:
                return best
        if best[0]:
            break
    return best


def scan(text: str, templates: dict[str, list[str]], least: float) -> list[tuple[str, float, int, int]]:
    """name, coverage, first and last matched word (end exclusive) of every template with at least this coverage, best first."""
    words = TOKEN.findall(text.lower())
    present = set(words)
    likely = {k: t for k, t in templates.items() if sum(w in present for w in t) >= least * len(t)}
    if not likely:
        return []
    places: dict[str, list[int]] = defaultdict(list)
    wanted = {w for t in likely.values() for w in t}
    for i, w in enumerate(words):
        if w in wanted:
            places[w].append(i)
    found = []
    for name, t in likely.items():
        at = sorted(p for w in set(t) for p in places.get(w, ()))
        n, start, end = best_window(at, [words[p] for p in at], t, least)
        if n:
            found.append((name, n / len(t), start, end))
    return sorted(found, key=lambda x: (-x[1], -len(templates[x[0]]), x[0]))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.9) -> DataFrame:
    """doc_id, n_licenses, license (best), coverage, start_word, end_word, all_licenses (in this order)."""
    parsed = {k: TOKEN.findall(v.lower()) for k, v in (TEMPLATES if templates is None else templates).items()}

    def run(ids: list, texts: list) -> dict:
        hits = [scan(t, parsed, least) for t in texts]
        best = [h[0] if h else (None, None, None, None) for h in hits]
        return {"doc_id": ids, "n_licenses": [len(h) for h in hits], "license": [b[0] for b in best], "coverage": [b[1] for b in best], "start_word": [b[2] for b in best], "end_word": [b[3] for b in best], "all_licenses": [",".join(x[0] for x in h) for h in hits]}

    return per_batch(id_and_text(docs), "doc_id long, n_licenses long, license string, coverage double, start_word long, end_word long, all_licenses string", run)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


QUERIES = {"op3_license_scan": op3_license_scan}
SQL: dict[str, str] = {}
