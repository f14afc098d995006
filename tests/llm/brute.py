"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import defaultdict
from functools import cache

import numpy as np

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text):
    return [w for w in WHITE.split(text or "") if w]


def similar(texts, k, percent):
    """doc_id -> (size, smallest linked)"""
    sets = {}
    for i, t in texts.items():
        w = words(lowered(t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def kept_lines(texts, least=10):
    """doc_id -> (lines, dropped, text)"""
    key = lambda line: lowered(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = {}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or min(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def longest(a, b):
    """Pairs of places of a longest common subsequence, by a whole table."""
    best = {}
    for i in range(len(a), -1, -1):
        for j in range(len(b), -1, -1):
            if i == len(a) or j == len(b):
                best[i, j] = 0
            else:
                best[i, j] = best[i + 1, j + 1] + 1 if a[i] == b[j] else max(best[i + 1, j], best[i, j + 1])
    return best[0, 0]


def patience(a, b):
    """Words that patience alignment matches; of equally long chains of anchors the one that is leftmost in a, read from its end."""
    if not a or not b:
        return 0
    if a[0] == b[0]:
        return 1 + patience(a[1:], b[1:])
    if a[-1] == b[-1]:
        return 1 + patience(a[:-1], b[:-1])
    anchors = [(a.index(w), j) for j, w in enumerate(b) if a.count(w) == b.count(w) == 1]
    if not anchors:
        return longest(a, b)
    length = []
    for k, (i, _) in enumerate(anchors):
        length.append(1 + max((length[m] for m in range(k) if anchors[m][0] < i), default=0))
    cuts, k = [(len(a), len(b))], len(anchors)
    for n in range(max(length), 0, -1):
        k = min((m for m in range(k) if length[m] == n), key=lambda m: anchors[m][0])
        cuts.append(anchors[k])
    cuts = [(-1, -1), *cuts[::-1]]
    return max(length) + sum(patience(a[i + 1 : k], b[j + 1 : m]) for (i, j), (k, m) in zip(cuts, cuts[1:]))


def covered(words, template, width):
    """Most template words that patience alignment matches in a window of this width."""
    starts = [p for p, w in enumerate(words) if w in template]
    return max((patience([w for w in words[p : p + width] if w in template], template) for p in starts), default=0)


def without_repeats(texts, least=100):
    """doc_id -> (bytes, removed, runs, hash)"""
    seen, out = set(), {}
    for i in sorted(texts):
        t = (texts[i] or "").encode()
        gone = [False] * len(t)
        for p in range(len(t) - least + 1):
            w = t[p : p + least]
            if w in seen:
                gone[p : p + least] = [True] * least
            seen.add(w)
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def quality_base(text):
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def pii(text):
    digits = lambda x: re.sub("[^0-9]", "", x)

    def luhn(x):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(x))) % 10 == 0

    t = text or ""
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]


@cache
def disclosing(texts, context, least=3, threshold=0.8):
    """(entity, term): terms by whole texts; context(text, start, end) is what must differ."""
    texts = {t or "" for t in texts}
    n = len(texts) + 1
    words_of = {t: set(re.findall(r"[^\W_]{4,}", t)) for t in texts}
    holders, contexts, outside = defaultdict(set), defaultdict(set), {}
    for t in texts:
        spans = pii(t)
        spans += keys(t, spans)
        outside[t] = {m[0] for m in re.finditer(r"[^\W_]{4,}", t) if not any(m.start() < b and a < m.end() for _, a, b in spans)}
        for k, a, b in spans:
            entity = f"{k}:{t[a:b].lower()}"
            holders[entity].add(t)
            contexts[entity, t].add(repr(context(t, a, b)))
    out = set()
    for e, of_e in holders.items():
        for term in set().union(*(outside[t] for t in of_e)):
            both = {t for t in of_e if term in words_of[t]}
            n_term = sum(term in w for w in words_of.values())
            seen = set().union(*(contexts[e, t] for t in both))
            pmi, ic = math.log(n * len(both) / (n_term * len(of_e))), math.log(n / len(of_e))
            if len(both) >= least and len(seen) >= least and pmi / ic >= threshold:
                out.add((e, term))
    return out


def shortest_pack_first(histogram, room):
    """Fill of each pack after placing pieces one by one, longest first, each on the pack filled least if it has room."""
    packs = []
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        at = min(range(len(packs)), key=packs.__getitem__, default=None)
        if at is None or packs[at] + n > room:
            packs.append(n)
        else:
            packs[at] += n
    return packs


COMMON = {
    "en": ["the", "of", "and", "to", "in"],
    "de": ["der", "die", "und", "in", "den"],
    "fr": ["de", "la", "le", "et", "les"],
    "es": ["de", "la", "que", "el", "en"],
}


def distance(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    part = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
    return math.sqrt(max(0, part(p) + part(q)) / 2)


def quality(docs, chars=0.165, word=0.18):
    """Ids of the documents (id -> text, lang) that are kept."""
    rows = {}
    for i, (text, lang) in docs.items():
        n, n_chars, _, _, again = quality_base(text)
        w, t = words(text), text or ""
        solid = "".join(w)
        digits = sum(c in "0123456789" for c in solid)
        odd = [sum("A" <= c <= "Z" for c in solid), sum(c in ".,;:!?'\"()-" for c in solid), sum(c in "#*$%&|<>" for c in solid)]
        lower = sum("a" <= c <= "z" for c in solid)
        classes = [*odd, len(t) - n_chars, lower, n_chars - digits - lower - sum(odd)]
        lang = lang if lang in COMMON else "other"
        found = [w.count(c) for c in COMMON.get(lang, ())]
        rows[i] = (lang, n, len(t), n_chars, digits, classes, [*found, n - sum(found)] if found else None, n < 50 or 100 * again > 50 * n)

    def reference(some, k, of):
        shares = [[math.floor(1000 * r[k][j] / of(r) + 0.5) for r in some] for j in range(len(some[0][k]))]
        return [float(np.median(x)) for x in shares]

    good = [r for r in rows.values() if not r[7]]
    kept = set()
    for i, (lang, n, size, n_chars, digits, classes, found, failed) in rows.items():
        if failed:
            continue
        own = [r for r in good if r[0] == lang] if lang != "other" else good
        far = distance(classes, reference(own, 5, lambda r: sum(r[5])))
        far_words = distance(found, reference(own, 6, lambda r: r[1])) if found else 0
        if not (size >= 200 and (far > chars or 100 * digits > 30 * n_chars)) and not (n >= 100 and far_words > word):
            kept.add(i)
    return kept


KINDS = ("email", "ip", "card", "phone")


def keys(text, base):
    out = []
    for m in re.finditer(r"[A-Za-z0-9]+", text):
        s = m[0]
        bits = -sum(math.log2(s.count(c) / len(s)) for c in s)
        turns = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False))
        if len(s) >= 20 and bits >= 64 and turns >= 4 and not any(m.start() < b and a < m.end() for _, a, b in base):
            out.append(("key", *m.span()))
    return out


def sanitised(text, texts):
    """The text without its spans, given all texts of the corpus."""
    from tracklark.llm.op09_pii import context

    base = pii(text)
    spans = base + keys(text, base)
    own = {f"{k}:{text[a:b].lower()}" for k, a, b in spans}
    gone = {t for e, t in disclosing(tuple(texts), context) if e in own}
    spans += [("term", *m.span()) for m in re.finditer(r"[^\W_]{4,}", text) if m[0] in gone and not any(m.start() < b and a < m.end() for _, a, b in spans)]
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], "" if k == "term" else f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def maximal_repeats(texts, least=100):
    """All strings of at least this many bytes that stand at several places and whose places do not all go on alike to either side."""
    data = {i: (t or "").encode() for i, t in texts.items()}
    at = defaultdict(set)
    for i, t in data.items():
        for k in range(len(t) - least + 1):
            at[t[k : k + least]].add((i, k))
    out, now, n = set(), {w: p for w, p in at.items() if len(p) > 1}, least
    while now:
        longer = defaultdict(set)
        for w, places in now.items():
            before = {data[i][k - 1] if k else None for i, k in places}
            after = [data[i][k + n] if k + n < len(data[i]) else None for i, k in places]
            if (len(before) > 1 or None in before) and (len(set(after)) > 1 or None in after):
                out.add(frozenset((i, k, k + n) for i, k in places))
            for (i, k), c in zip(places, after, strict=True):
                if c is not None:
                    longer[w, c].add((i, k))
        now = {w: p for w, p in longer.items() if len(p) > 1}
        n += 1
    return out
