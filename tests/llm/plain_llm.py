"""Plain versions of the operators, and a small table with every odd case."""

from __future__ import annotations

import hashlib
import random

DOCS = "doc_id bigint, text string, lang string, source string, row string, hash bigint, found int, id int"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def words(rng, n, vocabulary=2000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    """Texts by id: copies, near copies, shared passages, repeats inside a text, odd texts."""
    rng = random.Random(5)
    texts = {i: " ".join(words(rng, rng.randrange(5, 120))) for i in range(100, 150)}
    base = words(rng, 200)
    for i in range(10):  # near copies: a word or two replaced
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(200)] = "other"
        texts[150 + i] = " ".join(w)
    passage = " ".join(words(rng, 60))
    for i in range(8):  # a passage that repeats across documents, and within one
        texts[160 + i] = " ".join(words(rng, 30)) + " " + passage + " " + " ".join(words(rng, 9 + i))
    texts[168] = f"{passage} and {passage} and {passage}"
    texts[169] = "same word " * 60
    for i in range(6):  # exact copies
        texts[170 + i] = texts[100]
    texts[176] = texts[100].upper().replace(" ", "\t\n ")
    texts[177] = "one"
    texts[178] = "ONE"
    texts[179] = "two words"
    texts[180] = "two  words "
    texts[181] = None
    texts[182] = ""
    texts[183] = " \t\n"
    texts[184] = "é" * 70 + "日本 語 text" + "é" * 30
    texts[185] = "x" + "é" * 80
    texts[186] = " ".join(words(rng, 20000, 50000))  # very long
    texts[187] = " ".join(texts[186].split()[300:9000])
    texts[188] = None
    return texts


def rows(texts):
    """The texts as rows with clashing columns; some rows repeat, some ids are null."""
    sources = ["web", "books", None, "code"]
    out = [
        (i, t, None if i % 5 == 0 else "en", "web" if i % 3 else sources[i % 4], "r", i, 1, None)
        for i, t in texts.items()
    ]
    return [*out, out[3], out[3], (None, "a text without an id", None, None, None, None, None, None)]


def split(text):
    return (text or "").encode().split()


def shingle_set(text, size=3):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def smallest_reachable(ids, links):
    """Component of every id."""
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def near_duplicates(texts, size=3, percent=85):
    """id: (set size, component, kept), by comparing all pairs."""
    sets = {i: shingle_set(t, size) for i, t in texts.items()}
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    part = smallest_reachable(sets, links)
    return {i: (len(s), part[i], part[i] == i) for i, s in sets.items()}


def repeated_bytes(texts, size=50):
    """id: (bytes, removed, spans, digest of the rest)."""
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone, own = [False] * len(b), set()
        for p in range(len(b) - size + 1):
            s = b[p : p + size]
            own.add(s)
            if s in seen:
                gone[p : p + size] = [True] * size
        seen |= own
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def repeated_words(texts, size=20):
    """id: (words, removed, digest of the rest)."""
    seen, out = set(), {}
    for i in sorted(texts):
        w = split(texts[i])
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            s = tuple(w[p : p + size])
            if s in seen:
                gone[p : p + size] = [True] * size
            seen.add(s)
        rest = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(rest).hexdigest())
    return out


def holds(doc, item, window=13, replaced=2, least=5):
    """Whether a token list holds an item: a window with few tokens replaced, or all of a short one."""
    n = min(window, len(item))
    if len(item) < least:
        return False
    allowed = replaced if len(item) >= window else 0
    return any(
        sum(x != y for x, y in zip(item[k : k + n], doc[p : p + n])) <= allowed
        for k in range(len(item) - n + 1)
        for p in range(len(doc) - n + 1)
    )
