"""Plain-Python counterparts of the training-data operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def repeated_words(w):
    n = Counter(zip(w, w[1:], w[2:]))
    return len({i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if n[g] > 1 for k in range(3)})


def normal(line):
    line = re.sub(r"[\x20\x09\x0B-\x0D]+", " ", line.lower()).strip(" ")
    return re.sub("[1-9]", "0", line)


def quality(rows, min_docs, max_share, min_left):
    """rows: (doc_id, text, source), distinct -> {row: (base columns, kept, cleaned text)}"""
    seen, size = defaultdict(set), Counter(r[2] for r in rows)
    order = lambda r: (r[0] is not None, r[0] or 0)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if normal(x):
                seen[r[2], normal(x)].add(r)
    bad = {k: min(v, key=order) for k, v in seen.items() if len(v) > min_docs and len(v) > max_share * size[k[0]]}
    out = {}
    for r in rows:
        t, w = r[1] or "", words(r[1])
        lines = t.split("\n")
        drop = [normal(x) != "" and bad.get((r[2], normal(x)), r) != r for x in lines]
        full = [x for x in lines if x.strip(" \t\x0b\x0c\r")]
        chars = sum(len(normal(x)) for x in lines)
        lost = sum(len(normal(x)) for x, d in zip(lines, drop) if d)
        rep = repeated_words(w)
        failed = len(w) < 50 or 100 * rep > 50 * len(w)
        base = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), rep, failed)
        kept = not failed and chars - lost >= min_left * chars
        clean = "\n".join(x for x, d in zip(lines, drop) if not d) if any(drop) else r[1]
        out[r] = (*base, kept, clean)
    return out


def line_dedup(rows):
    """rows: (doc_id, text) in order -> texts without later three-line windows."""
    seen, out = {}, []
    for d, text in rows:
        lines = (text or "").split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" \t\x0b\x0c\r")]
        drop = set()
        for at in zip(full, full[1:], full[2:]):
            key = tuple(lines[i] for i in at)
            if seen.setdefault(key, (d, at)) != (d, at):
                drop |= set(at)
        out.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text)
    return out


def fingerprint(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(values, max_bits=4):
    """values: distinct integers -> {value: root}"""
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    values = list(values)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= max_bits:
                root[find(a)] = find(b)
    return {v: find(v) for v in values}


def simhash(rows, k=4, max_bits=4):
    """rows: (doc_id, text) -> [(doc_id, fp, component)]"""
    prints = [(d, fingerprint(t, k)) for d, t in rows]
    root = groups({f for _, f in prints}, max_bits)
    least = defaultdict(list)
    for d, f in prints:
        if d is not None:
            least[root[f]].append(d)
    return [(d, f, min(least[root[f]], default=None)) for d, f in prints]


def substrings(rows, length=50):
    """rows: (doc_id, text) -> [(doc_id, bytes, removed, spans, sha256 of the rest)]"""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            if d is not None:
                first[b[i : i + length]] = min(d, first.get(b[i : i + length], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if d is not None and first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        spans = sum(x and not y for x, y in zip(gone, b"\0" + bytes(gone)))
        left = bytes(x for x, y in zip(b, gone) if not y)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def tokens(text):
    t = re.sub(r"[.,;:!?\"'()\[\]{}«»¿¡…*_]", " ", text or "")
    return words(re.sub("[A-Z]", lambda m: m[0].lower(), t))


def stretch(a, b, penalty):
    """Best (score, start, end) over aligned words, by trying all stretches."""
    best = (0, 0, 0)
    for i in range(min(len(a), len(b))):
        score = 0
        for j in range(i, min(len(a), len(b))):
            score += 1 if a[j] == b[j] else -penalty
            if score > best[0]:
                best = (score, i, j + 1)
    return best


def contaminated(docs, items, masks, penalty, min_score, min_span):
    """docs, items: [(id, text)] -> {(doc_id, item_id): (first word, end word, equal words, score)}; without masks
    every diagonal is tried."""
    seeds = defaultdict(set)
    span = len(masks[0]) if masks else 0
    pick = lambda w, i, m: (m, *(w[i + j] for j, c in enumerate(m) if c == "1"))
    known = defaultdict(list)
    for item, t in items:
        w = tokens(t)
        if w not in known[item]:
            known[item].append(w)
        for i in range(len(w) - span + 1 if masks else 0):
            for m in masks:
                seeds[pick(w, i, m)].add((item, known[item].index(w), i))
    out = {}
    for d, t in docs:
        w = tokens(t)
        if masks:
            diagonals = {
                (item, v, i - j) for i in range(len(w) - span + 1) for m in masks for item, v, j in seeds.get(pick(w, i, m), ())
            }
        else:
            diagonals = {(item, v, g) for item in known for v, k in enumerate(known[item]) for g in range(1 - len(k), len(w))}
        for item, v, g in diagonals:
            a, b = (w[g:], known[item][v]) if g >= 0 else (w, known[item][v][-g:])
            score, s, e = stretch(a, b, penalty)
            if score >= min_score and e - s >= min_span:
                found = (score, -(s + max(g, 0)), e + max(g, 0), (penalty * (e - s) + score) // (penalty + 1))
                out[d, item] = max(out.get((d, item), (0,)), found)
    return {key: (-first, end, equal, score) for key, (score, first, end, equal) in out.items()}
