"""Run detection against a brute-force search over all periods."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import types as T

from wakeline.llm import QUERIES, periodic

SF = "/root/testdata/sf0.001"


def brute_runs(w, least=12):
    """Every period in turn, all its matches compared."""
    out, number = [], {}
    ids = np.array([number.setdefault(x, len(number)) for x in w], np.int64)
    for q in range(1, len(w) // 2 + 1):
        same = np.concatenate([[0], (ids[:-q] == ids[q:]).astype(np.int8), [0]])
        starts, ends = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for a, e in zip(starts.tolist(), ends.tolist()):
            s = w[a : e + q]
            if len(s) >= max(least, 2 * q) and not any(s[p:] == s[:-p] for p in range(1, q)):
                out.append((a, len(s), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, alter=True):
    w = [x for x in (text or "").translate({c: 32 for c in range(9, 14)}).split(" ") if x]
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if alter and doc_id is not None and h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    text = " ".join(x for i, x in enumerate(w) if i not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{a},{length},{q}\n" for a, length, q in runs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(listed), sha(text))


def test_runs_random():
    rng = random.Random(7)
    for t in range(3000):
        w = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(60))]
        if t % 2 and w:
            a, p = rng.randrange(len(w)), rng.randrange(1, 12)
            w = [w[i] if i < a + p else w[a + (i - a) % p] for i in range(len(w))]
        if t % 3 == 0:
            w = (w * 6)[: rng.randrange(1, 200)]
        least = rng.choice([12, 12, 2, 5, 16])
        assert periodic.periodic_runs(w, least) == brute_runs(w, least)


def test_runs_long():
    """Texts in which earlier occurrences are many still take few steps a word."""
    assert periodic.periodic_runs(["a"] * 300_000) == [(0, 300_000, 1)]
    found = periodic.periodic_runs((["a"] * 4999 + ["b"]) * 12)
    assert found == sorted([(0, 60_000, 5000), *[(i * 5000, 4999, 1) for i in range(12)]], key=lambda r: (r[0], r[2]))
    split = ["a"] * 9000 + ["b"] + ["a"] * 9000
    assert periodic.periodic_runs(split) == [(0, 9000, 1), (9001, 9000, 1)]
    old, word = ["a"], ["a", "b"]
    while len(word) < 300:
        old, word = word, word + old
    assert periodic.periodic_runs(word) == brute_runs(word)


def test_find_runs_edges(spark):
    schema = "doc_id long, text string, runs string, n_words int, start long, length long, period string"
    loop = "a b c " * 10
    rows = [
        (None, loop), (1, None), (1, ""), (2, " \t\n"), (3, loop), (3, loop), (4, "Ä\x1fx é " * 7), (5, "x " * 11),
        (6, "x " * 12), (7, "p q r s t u " * 2), (8, "p q r s t u " * 1 + "p q r s t"), (9, "w " * 200_000),
    ]
    docs = spark.createDataFrame([(*r, "c", 1, 2, 3, "z") for r in rows], schema)
    got = periodic.find_runs(docs).collect()
    assert len(got) == len(rows)
    for (doc_id, text), r in zip(rows, got):
        w = (text or "").encode().split()
        if len(w) > 1000:
            assert [tuple(x) for x in r.runs] == [(0, len(w), 1)] and r.text == "w"
        else:
            assert (r.doc_id, r.n_words, [tuple(x) for x in r.runs]) == (doc_id, len(w), brute_runs(w))
    empty = periodic.find_runs(docs.limit(0))
    assert empty.collect() == [] and empty.schema["runs"].dataType.elementType["period"].dataType == T.LongType()


def test_query_whole_table(spark):
    got = sorted(map(tuple, QUERIES["op13_periodic_runs"](spark, SF).collect()))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted(brute_row(*d) for d in docs)
    assert any(r[1] for r in got)
