"""Slow versions of the operators, in plain Python on small tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np

from tessera.llm import common, langid, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n if i is not None else -1


def base(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    w = WORD.findall(text or "")
    c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    cover = {j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)


def one_hash(token: bytes) -> int:
    data = np.frombuffer(token, np.uint8)
    return int(common.hash_segments(data, np.array([0]), np.array([len(data)]))[0])


def quality_grams(text):
    """The buckets of a text's unigrams and bigrams."""
    h = [one_hash(t) for t in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", (text or "").encode())]
    two = [int(common.mix(np.array([(a * 3 + b) % (1 << 64)], np.uint64))[0]) for a, b in zip(h, h[1:])]
    return [x >> (64 - quality.BITS) for x in h + two]


def judged(docs, labels):
    """(llr, kept) of each (id, text), from (id, quality) rows."""
    said = {}
    for i, q in labels:
        if i is not None and q is not None:
            said[i] = min(q, said.get(i, q))
    grams = [quality_grams(t) for _, t in docs]
    raw, target = collections.Counter(), collections.Counter()
    for (i, _), g in zip(docs, grams):
        raw.update(g)
        if said.get(i, 0) > 0 and crc(i, 2) == 0:
            target.update(g)
    size = 1 << quality.BITS
    if not any(q > 0 and crc(i, 2) == 0 for i, q in said.items()):
        return [(0.0, not base(t)[5]) for _, t in docs]
    log = lambda c, x: math.log((c[x] + 0.5) / (sum(c.values()) + 0.5 * size))
    table = {x: log(target, x) - log(raw, x) for x in raw}
    llr = [sum(table[x] for x in g) / len(g) if g else 0.0 for g in grams]
    held = [(s, said[i] > 0) for (i, _), s in zip(docs, llr) if i in said and crc(i, 2) == 1]
    place = lambda s: min(quality.BINS - 1, max(0, int((s - quality.LOW) / (quality.HIGH - quality.LOW) * quality.BINS)))
    good, bad = [place(s) for s, q in held if q], [place(s) for s, q in held if not q]
    edges = [e for e in range(quality.BINS + 1) if sum(b < e for b in good) <= quality.SPARE * max(1, len(good))]
    most = max((sum(b < e for b in bad) for e in edges), default=0)
    best = [e for e in edges if sum(b < e for b in bad) == most]
    least = quality.LOW + (quality.HIGH - quality.LOW) * (best[0] + best[-1]) / 2 / quality.BINS if most else -math.inf
    return [(s, not base(t)[5] and s >= least) for (_, t), s in zip(docs, llr)]


def language_grams(text):
    out = collections.Counter()
    for w in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").lower().encode()):
        s = b" " + w + b" "
        out.update(s[k : k + n] for n in langid.SIZES for k in range(len(s) - n + 1))
    return out


def profiles(docs):
    """The set of n-grams of each language, from (id, text, lang) rows."""
    counts = collections.defaultdict(collections.Counter)
    for i, t, lang in docs:
        if lang is not None and crc(i, 4) != 2:
            counts[lang].update(language_grams(t))
    counts = {k: c for k, c in counts.items() if c}
    rate = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in counts.items()}
    top = collections.defaultdict(float)
    for r in rate.values():
        for g, x in r.items():
            if x >= langid.MIN_RATE:
                top[g] = max(top[g], x)
    return {k: {g for g, x in r.items() if x >= langid.MIN_RATE and x >= langid.SHARE * top[g]} for k, r in rate.items()}, {k: sum(c.values()) for k, c in counts.items()}


def language(text, sets, totals):
    if not any(map(str.isalpha, text or "")) or not sets:
        return "und", 0.0
    g = language_grams(text)
    hits = {k: sum(n for x, n in g.items() if x in s) for k, s in sorted(sets.items())}
    if not sum(hits.values()):
        return max(sorted(totals), key=lambda k: totals[k]), 0.0
    best = max(hits, key=lambda k: hits[k])
    return best, hits[best] / sum(hits.values())


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    """The class of each (id, text) by links of all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = up[a], up[b]
                up = [new if u == old else u for u in up]
    return up, sets


def poisson(u, rate):
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u and k < 600:
        k += 1
        p = p * rate / k
        total += p
    return k


def uniform(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52
