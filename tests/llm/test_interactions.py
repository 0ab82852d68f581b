"""The filter audit against a brute force over all orders, and SQL on the given tables."""

import itertools
import random
from collections import Counter

from compare import canon, connect
from wakeline.llm import ORACLES, QUERIES, interactions

SF = "/root/testdata/sf0.001"


def fails(doc_id, text, table):
    words = [w for w in text.translate({c: 32 for c in range(9, 14)}).split(" ") if w]
    return "".join(
        f
        for f, hit in zip(
            "ABCDE",
            [
                len(words) < 200,
                100 * len(set(words)) < 50 * len(words),
                100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
                any(c in "#$%&*|" for c in text),
                doc_id is not None and any(d is not None and d < doc_id and t == text for d, t in table),
            ],
        )
        if hit
    )


def brute(rows, labels):
    """rows of (doc_id, lang, text); labels of (doc_id, quality, toxic)."""
    table = [(d, t or "") for d, _, t in rows]
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    docs = [(d, lang or "", fails(d, t or "", table)) for d, lang, t in rows]
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in docs}:
        own = [(d, f) for d, p, f in docs if p == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for k, x in enumerate(order):
                gone = [(d, f) for d, f in left if x in f]
                left = [(d, f) for d, f in left if x not in f]
                shapley[part, x] += len(gone)
                out[part, order, k + 1] = (
                    len(left), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == x for _, f in own),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone),
                )
    return sorted((*key, *v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items())


def run(spark, rows, labels, **how):
    schema = "doc_id long, lang string, text string, mask int, range string, part string, n long, h int"
    docs = spark.createDataFrame([(*r, 1, "x", "y", 2, 3) for r in rows], schema)
    said = spark.createDataFrame([(*x, "z", "p") for x in labels], "doc_id long, quality int, toxic int, part string, mask string")
    masks = interactions.filter_masks(docs, **how)
    return sorted(map(tuple, interactions.interactions(masks, said).collect()))


def test_against_sql(spark):
    con = connect("sf0.001")
    df = QUERIES["op11_filter_interactions"](spark, SF)
    cols = sorted(df.columns)
    got = canon([tuple(r) for r in df.select(*cols).collect()])
    assert got == canon(con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES['op11_filter_interactions']})").fetchall())


def test_edges(spark):
    prose = lambda seed, n: " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 9973}" for i in range(n))
    long = prose(3, 60_000)
    rows = [
        (None, None, None), (None, "en", ""), (1, "en", None), (2, None, ""), (3, "de", "A B C # A"), (3, "de", "A B C # A"),
        (3, "en", "other"), (4, "fr", "A B C # A"), (5, "en", long), (6, "en", long), (7, "de", long + "x"), (None, "de", long),
        (8, "en", prose(8, 300)), (9, "en", prose(8, 300) + " Ä"), (10, "", "a " * 300), (11, "en", "é" * 50 + "\x1f"),
        (12, "fr", "THE " * 200), (-4, "fr", "THE " * 200),
    ]
    labels = [(1, 1, 0), (1, 1, 1), (3, 0, 1), (4, 1, None), (8, None, None), (None, 1, 1), (6, 1, 0), (10, 1, 1), (99, 1, 1)]
    want = brute(rows, labels)
    assert run(spark, rows, labels) == want
    # tries and ranges begun anew every few bytes change nothing
    assert run(spark, rows, labels, held_bytes=100, range_bytes=2000) == want
    assert run(spark, rows, []) == brute(rows, [])
    assert run(spark, [], labels) == []


def test_ranges_part_copies_and_shared_prefixes(spark):
    rng = random.Random(4)
    head = "the same beginning of very many texts " * 30
    rows = [(i, "en", head + str(rng.randrange(400))) for i in range(1500)]
    rows += [(5000 + i, "de", "one hot text") for i in range(1500)] + [(9000 + i, "fr", str(i)) for i in range(500)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    heavy, tasks = interactions.text_ranges(docs.select("text"), 8)
    assert tasks == 8 and len(heavy) > 3 and all(h.count() <= 4 * tasks for h in heavy)
    spread = interactions._with_range(docs, heavy).groupBy("range").count().collect()
    assert len(spread) > 100
    first = {}
    for d, _, t in rows:
        first[t] = min(d, first.get(t, d))
    got = {(r.doc_id, bool(r.mask & interactions.DUPLICATE)) for r in interactions.filter_masks(docs).collect()}
    assert got == {(d, d != first[t]) for d, _, t in rows}


def test_trie():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab") * rng.randrange(1, 40) for _ in range(rng.randrange(4))).encode() for _ in range(3000)]
    trie, new = interactions.Trie(), 0
    for i, t in enumerate(texts):
        new += trie.insert(t, (i,))
    found = {t: sorted(d for (d,) in docs) for t, docs in trie.terminals()}
    assert found == {t: [i for i, x in enumerate(texts) if x == t] for t in set(texts)}
    assert new < sum(map(len, set(texts)))
