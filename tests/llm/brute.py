"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeats(docs, length=200):
    """Rows of (doc_id, n_bytes, n_removed, n_spans, kept_sha256), in order."""
    texts = [(k, (t or "").encode()) for k, t in docs]
    seen = Counter(b[p : p + length] for _, b in texts for p in range(len(b) - length + 1))
    out = []
    for k, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or {tuple(words)}


def near(docs, size, percent):
    """Rows of (doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [shingles(t, size) for _, t in docs]
    group = list(range(len(docs)))
    find = lambda i: i if group[i] == i else find(group[i])
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    group[find(i)] = find(j)
    ids = defaultdict(list)
    for i in range(len(docs)):
        ids[find(i)].append(docs[i][0])
    least = {g: min((k for k in v if k is not None), default=None) for g, v in ids.items()}
    return [(docs[i][0], len(sets[i]), least[find(i)]) for i in range(len(docs))]


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    body = text or ""
    words = WORD.findall(body)
    lines = [x for x in body.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in body), len(lines) - len(set(lines)), len(hit)


def lm_base(docs):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score)."""
    tokens = {k: WORD.findall((t or "").translate(LOWER)) + [None] for k, t in docs}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in tokens}
    count = Counter(t for k, x in tokens.items() if not held[k] for t in x)
    n, v = sum(count.values()), len(count)
    return {k: (held[k], len(x), sum(count[t] > 0 for t in x), n, sum(math.log10((count[t] + 1) / (n + v + 1)) for t in x)) for k, x in tokens.items()}
