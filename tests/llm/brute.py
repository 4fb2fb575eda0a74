"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")


def words(text):
    return SPACE.findall((text or "").encode().lower())


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if 2 * d > 9 else 2 * d)
    return total % 10 == 0


def base_spans(text):
    text, out = text or "", []
    out += [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(re.findall("[0-9]", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def shingles(text, width):
    found = words(text)
    if not found:
        return frozenset()
    n = min(width, len(found))
    return frozenset(tuple(found[i : i + n]) for i in range(len(found) - n + 1))


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_texts(texts, width, percent=80):
    """{id: (set size, component)} from {id: text}, by counting shared shingles of all pairs."""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter((a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    links = [
        (a, b) for (a, b), n in common.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)
    ]
    root = components(texts, links)
    return {i: (len(sets[i]), root[i]) for i in texts}


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def near_vectors(rows, cosine=0.98):
    """{id: (links, component)} from (id, vector, label) rows."""
    ids = [i for i, _, _ in rows]
    good = [(i, np.array(v, float), label) for i, v, label in rows if usable(v) and label is not None]
    links = []
    for k, (a, x, la) in enumerate(good):
        for b, y, lb in good[k + 1 :]:
            if la == lb and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                links.append((a, b))
    count = Counter(i for pair in links for i in pair)
    root = components(ids, links)
    return {i: (count[i], root[i]) for i in ids}


def targets(sizes, weights=(5, 2, 1), most=3):
    """{source: target} by resharing the excess until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, rest = {}, list(names), float(sum(sizes.values()))
    while free:
        share = rest / sum(weight[s] for s in free)
        above = [s for s in free if weight[s] * share > most * sizes[s]]
        if not above:
            return out | {s: weight[s] * share for s in free}
        for s in above:
            out[s] = float(most * sizes[s])
            rest -= out[s]
            free.remove(s)
    return out


def crc(key, folds):
    return zlib.crc32(str(key).encode()) % folds
