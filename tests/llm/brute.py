"""Plain versions of the operators, for small tables. rows are tuples as named in each function."""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from functools import cache

import numpy as np


@cache
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 2]


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingle_set(text, k):
    words = [w for w in re.split("[\x20\x09-\x0d]+", lower(text or "")) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def jaccard_components(rows, k, percent):
    """rows: (doc_id, text). [(doc_id, set size, component)]"""
    sets = [shingle_set(t, k) for _, t in rows]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in where[x]:
                if j > i:
                    shared[j] = shared.get(j, 0) + 1
        for j, c in shared.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                up[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [(d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def decontamination(docs, items, span=10):
    """[(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)]"""
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t or ""))
    windows = {}
    for item, text in items:
        w = split(text)
        if w and item is not None:
            for i in range(max(1, len(w) - span + 1)):
                windows.setdefault(tuple(w[i : i + span]), set()).add(str(item))
    sizes = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w = split(text)
        hit, found = set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if (x := tuple(w[i : i + m])) in windows:
                    hit.update(range(i, i + m))
                    found |= windows[x]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def sstable(rows):
    """[(doc_id, start, n_tokens, crc)] for distinct ids."""
    out, at = [], 0
    for d, t in sorted(rows):
        x = ids(t)
        out.append((d, at, len(x), crc(x)))
        at += len(x)
    return out


def canonical(text):
    text = unicodedata.normalize("NFKC", text or "")
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text.casefold())).strip(" ")


def edited(rows):
    """rows of distinct ids: [(doc_id, n_chars, edited sha256, same as edited, same as next)]"""
    rows = sorted(rows, reverse=True)
    out = []
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 3
        e = t[: len(t) - k] + after[:k]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), float(canonical(e) == canonical(t)), float(canonical(t) == canonical(after))))
    return out


def ftrl(examples, epochs, alpha, beta, l1, l2):
    """(weights by number, bias): each example is (label, {number: value}); the updates as published, a weight at a time."""
    z, n, bz, bn = {}, {}, 0.0, 0.0

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n.get(i, 0.0) ** 0.5) / alpha + l2)

    for epoch in range(epochs):
        for y, x in examples(epoch):
            w = {i: weight(i) for i in x}
            bias = -bz / ((beta + bn**0.5) / alpha)
            g = 1 / (1 + np.exp(-(sum(w[i] * v for i, v in x.items()) + bias))) - y
            for i, v in x.items():
                old = n.get(i, 0.0)
                n[i] = old + (g * v) ** 2
                z[i] = z.get(i, 0.0) + g * v - (n[i] ** 0.5 - old**0.5) / alpha * w[i]
            bz += g - ((bn + g * g) ** 0.5 - bn**0.5) / alpha * bias
            bn += g * g
    return {i: weight(i) for i in z}, -bz / ((beta + bn**0.5) / alpha)


def quality_features(text):
    """The n-grams of words and of word shapes, repeats included."""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    kind = lambda b: 2 if 48 <= b < 58 else 3 if 65 <= b < 91 else 1 if 97 <= b < 123 or b >= 128 else b if 33 <= b < 127 else 0
    shapes, last = [], None
    for w in words:
        b = w.encode()
        shapes.append((kind(b[0]), kind(b[-1]), kind(b[max(len(b) - 2, 0)]), sum(65 <= x < 91 for x in b) > 1, lower(w) == last))
        last = lower(w)
    runs = lambda xs, k: [tuple(xs[i : i + k]) for i in range(len(xs) - k + 1)]
    plain = [lower(w) for w in words]
    return [("word", *x) for k in (1, 2) for x in runs(plain, k)] + [("shape", *x) for k in (1, 2, 3) for x in runs(shapes, k)]


def without_boilerplate(rows, min_sites, min_chars):
    """rows: (text, site). Texts without the lines of min_chars characters or more that min_sites sites or more have."""
    sites = {}
    for text, site in rows:
        for line in (text or "").split("\n"):
            if len(line) >= min_chars:
                sites.setdefault(line, set()).add(site or "")
    bad = {line for line, s in sites.items() if len(s) >= min_sites}
    return [None if t is None else "\n".join(x for x in t.split("\n") if x not in bad) for t, _ in rows]
