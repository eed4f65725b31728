"""Plain versions of the operators, for comparison on small tables."""

import collections
import functools
import hashlib
import math
import re
import unicodedata

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall((text or "").encode())


def sha(data):
    return hashlib.sha256(data).hexdigest()


def byte_repeats(rows, width=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - width + 1):
            first[b[s:s + width]] = min(i, first.get(b[s:s + width], i))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - width + 1):
            if first[b[s:s + width]] < i:
                gone[s:s + width] = [True] * width
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g)))
    return out


def word_repeats(rows, width=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            x = tuple(w[s:s + width])
            if x in seen:
                gone[s:s + width] = [True] * width
            seen.add(x)
        out[i] = (len(w), sum(gone), sha(b" ".join(c for c, g in zip(w, gone) if not g)))
    return out


def jaccard_classes(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        sets[i] = set(zip(*[w[a:] for a in range(k)])) if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1:]:
            n = len(sets[i] & sets[j])
            if n and den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def contaminated(docs, items, window=12, agree=8):
    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for i, t in docs:
        d = tok(t)
        for j, u in items:
            b = tok(u)
            if len(b) < 8:
                continue
            w = min(window, len(b))
            for diag in range(-len(b), len(d)):
                same = [0 <= diag + p < len(d) and d[diag + p] == b[p] for p in range(len(b))]
                if any(10 * sum(same[s:s + w]) >= agree * w for s in range(len(b) - w + 1)):
                    out.add((i, j))
                    break
    return out


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def pii(text):
    out = []
    for kind, pattern in PII:
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]
            if good():
                out.append((kind, m.start(), m.end()))
    return out


def languages(train, texts, each, max_n=4, smoothing=0.5):
    """(lang, text) rows and texts -> (language, score) of each text, word by word and n-gram by n-gram."""
    letters = lambda t: "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (t or "").lower()).split()
    langs = sorted({lang for lang, t in train if lang is not None and letters(t)})
    counts = {(lang, n): collections.Counter() for lang in langs for n in range(max_n + 1)}
    for lang, t in train:
        for w in letters(t) if lang in langs else []:
            counts[lang, 0][w] += 1
            for n in range(1, max_n + 1):
                counts[lang, n].update(g for g in (f" {w} "[i:i + n] for i in range(len(w) + 3 - n)) if g.strip())
    kept = {k: {t: x for t, x in sorted(c.items(), key=lambda e: (-e[1], e[0]))[:each]} for k, c in counts.items()}

    def log_frequency(lang, n, t):
        c = counts[lang, n]
        return math.log((kept[lang, n].get(t, 0) + smoothing) / (sum(c.values()) + smoothing * (len(c) + 1)))

    @functools.cache
    def word(w):
        for n in (0, *range(max_n, 0, -1)):
            parts = [w] if n == 0 else [f" {w} "[i:i + n] for i in range(len(w) + 3 - n)]
            known = [t for t in parts if any(t in kept[lang, n] for lang in langs)]
            if known:
                return [sum(log_frequency(lang, n, t) for t in known) / len(known) for lang in langs]
        return [0.0] * len(langs)

    out = []
    for text in texts:
        words = letters(text)
        if not words or not langs:
            out.append(("und", 0.0))
            continue
        total = [sum(x) for x in zip(*map(word, words))]
        p = [math.exp((x - max(total)) / math.sqrt(len(words))) for x in total]
        best = total.index(max(total))
        out.append((langs[best], p[best] / sum(p)))
    return out
