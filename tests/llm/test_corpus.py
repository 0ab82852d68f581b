"""Operators that are stages of the pipeline, and the pipeline, against plain Python and SQL."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import brute
from compare import canon, connect
from wakeline.llm import ORACLES, QUERIES, decontam, linededup, mixing, quality, simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_lines string, epoch string, key int"


def documents(spark, rows):
    """Rows of (doc_id, text, source) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, None, s, None, None, "x", "y", 1) for d, t, s in rows], SCHEMA)


def prose(seed, n):
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 9973}" for i in range(n))


@pytest.fixture(scope="module")
def edge_rows():
    long = "\n".join(prose(i, 40) for i in range(3000))
    block = "\n".join(prose(900 + i, 30) for i in range(5))
    return [
        (None, None, None), (None, "", "a"), (None, block, None), (1, None, "a"), (2, "", None), (3, long, "a"),
        (4, block, "a"), (4, block, "a"), (5, block + "\nextra line here", "b"), (6, " \n\t\n ", "b"), (7, "one", None),
        (8, "a a a a a a", "a"), (9, "\n".join(["same line again"] * 6), "a"), (10, block, "a"), (10, "other text", "a"),
        (11, prose(5, 400), "c"), (12, prose(5, 400) + " w1", "c"), (13, "Éa ñ\x1f\x00   x", "c"),
    ]


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_against_sql(spark, key):
    con = connect("sf0.001")
    df = QUERIES[key](spark, SF)
    cols = sorted(df.columns)
    got = canon([tuple(r) for r in df.select(*cols).collect()])
    names = ", ".join(f'"{c}"' for c in cols)
    assert got == canon(con.execute(f"SELECT {names} FROM ({ORACLES[key]})").fetchall())


def test_quality_edges(spark, edge_rows):
    docs = documents(spark, edge_rows)
    report = quality.line_quality(docs, min_docs=1, max_share=0.0)
    want = brute.quality(list(dict.fromkeys(edge_rows)), 1, 0.0, quality.MIN_LEFT)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = sorted(str((r.key.doc_id, *[r[n] for n in names])) for r in report.collect())
    assert got == sorted(str((r[0], *want[r][:7])) for r in edge_rows)
    kept = quality.apply_quality(docs, report)
    assert kept.columns == docs.columns
    got = sorted(str((r.doc_id, r.text)) for r in kept.collect())
    assert got == sorted(str((r[0], want[r][7])) for r in edge_rows if want[r][6])


def test_quality_hot_line(spark):
    rows = [(i, f"the same line for all\n{prose(i, 60)}\n{prose(i + 5000, 60)}", "hot") for i in range(60)]
    want = brute.quality(rows, 20, 0.02, 0.5)
    report = quality.line_quality(documents(spark, rows))
    out = {r.doc_id: r.text for r in quality.apply_quality(documents(spark, rows), report).collect()}
    assert out == {r[0]: v[7] for r, v in want.items() if v[6]}
    assert sum("same line" in t for t in out.values()) == 1


def test_line_dedup_edges(spark, edge_rows):
    rows = [r for r in edge_rows if not (r[0] is None and r[1] != "")]
    unique = sorted(dict.fromkeys((d, t) for d, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    unique = [r for r in unique if r != (10, "other text")]  # ids repeat once more only with equal texts
    want = dict(zip(unique, brute.line_dedup(unique)))
    out = linededup.line_dedup(documents(spark, [r for r in rows if r[:2] in want]))
    assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == sorted(str((d, want[d, t])) for d, t, _ in rows if (d, t) in want)
    assert [t for c, t in out.dtypes if c in ("n_lines", "n_removed")] == ["bigint", "bigint"]


def test_line_dedup_overlaps(spark):
    lines = ["alpha", "beta", "gamma", "delta", "alpha", "beta", "gamma", "", "tail"]
    rows = [(1, "\n".join(lines), "s"), (2, "new\n\nalpha\n\nbeta\ngamma\ndelta\nend", "s")]
    out = {r.doc_id: (r.text, r.n_removed) for r in linededup.line_dedup(documents(spark, rows)).collect()}
    assert out == {1: ("alpha\nbeta\ngamma\ndelta\n\ntail", 3), 2: ("new\n\n\nend", 4)}


def test_fingerprints(spark, edge_rows):
    for _, text, _ in edge_rows:
        assert simhash.fingerprint(text) == brute.fingerprint(text)


@pytest.mark.parametrize("hot_root", [100_000, 3])
def test_trie_links_random(spark, hot_root):
    import random

    rng = random.Random(4)
    values = {rng.getrandbits(64) for _ in range(300)}
    for v in list(values)[:150]:  # chains of near values, bunches under one root
        for _ in range(3):
            for b in rng.sample(range(64), rng.choice([1, 3, 4, 5])):
                v ^= 1 << b
            values.add(v)
    for _ in range(200):
        values.add((0xABCDEF << 40) | rng.getrandbits(40))
    signed = [(v - (1 << 64) if v >= 1 << 63 else v,) for v in values]
    from wakeline.llm.components import components

    links = simhash.trie_links(spark.createDataFrame(signed, "fp long"), hot_root=hot_root)
    got = {r.node % (1 << 64): r.root for r in components(links).collect()}
    want = brute.groups(values)
    sets = lambda m: {frozenset(v for v in m if m[v] == r) for r in set(m.values())}
    assert sets(got) == {s for s in sets(want) if len(s) > 1}


def test_simhash_edges(spark, edge_rows):
    docs = documents(spark, edge_rows)
    out = simhash.simhash_groups(docs)
    got = sorted(str((r.doc_id, r.fp % (1 << 64), r.component_id)) for r in out.collect())
    want = brute.simhash([r[:2] for r in edge_rows])
    assert got == sorted(map(str, want))
    kept = sorted(str((r.doc_id, r.text)) for r in simhash.keep_one(docs, out).collect())
    assert len(kept) == len({c for *_, c in want}) and len(set(kept)) == len(kept)


def test_simhash_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op7_simhash_near_dedup"](spark, SF).collect())
    assert got == sorted((d, f"{f:016x}", c) for d, f, c in brute.simhash(docs))


def test_components_chain_and_star(spark):
    from wakeline.llm.components import components

    edges = [(i, i + 1) for i in range(200)] + [(1000, 2000 + i) for i in range(50)] + [(7, 7), (3, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000} | {2000 + i: 1000 for i in range(50)}


CHECKS = (decontam.PENALTY, decontam.MIN_SCORE, decontam.MIN_SPAN)
RULES = (decontam.MASKS, *CHECKS)


def overlaps(found):
    return {(r.key.doc_id, r.item_id): (r.first_word, r.end_word, r.n_equal, r.score) for r in found.collect()}


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_decontamination_query(spark, broadcast):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = overlaps(decontam.contaminated(docs, items, broadcast))
    pairs = lambda df: [tuple(r) for r in df.collect()]
    want = brute.contaminated(pairs(docs.select("doc_id", "text")), pairs(items.select("item_id", "text")), *RULES)
    assert got == want and want


def test_decontamination_edges(spark, edge_rows):
    passage = prose(77, 40).split()
    changed = [w if i not in (4, 9, 22, 27, 35) else "other" for i, w in enumerate(passage)]
    rows = edge_rows + [
        (50, "Start. " + " ".join(passage) + " end", "s"), (51, " ".join(passage[20:33]), "s"), (52, " ".join(changed), "s"),
        (53, " ".join(passage[:9]), "s"), (54, prose(3, 30) + " " + " ".join(changed).upper(), "s"), (54, "clean", "s"),
        (None, " ".join(passage), "s"),
    ]
    items = [(1, " ".join(passage)), (1, " ".join(passage)), (2, None), (3, "too short"), (None, prose(78, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows)
    got = overlaps(decontam.contaminated(docs, bench))
    assert got == brute.contaminated([r[:2] for r in rows], set(items), *RULES)
    assert {50, 51, 52, 54, None} <= {d for d, _ in got} and 53 not in {d for d, _ in got}
    out = decontam.decontaminate(docs, bench)
    assert out.columns == docs.columns and out.count() == len(rows) - len({d for d, _ in got})
    assert decontam.decontaminate(docs, bench.limit(0)).count() == len(rows)


@pytest.mark.parametrize("n, changed, least", [(12, 0.0, 1.0), (14, 0.1, 0.99), (20, 0.15, 0.98), (25, 0.2, 0.97), (40, 0.25, 0.97)])
def test_decontamination_finds_what_every_diagonal_would(spark, n, changed, least):
    """Passages with substituted words in otherwise foreign texts, against verification of all diagonals."""
    rng = random.Random(n)
    items = [(i, prose(500 + i, n)) for i in range(20)]
    rows = []
    for d in range(400):
        passage = [w if rng.random() >= changed else f"x{rng.random()}" for w in items[d % 20][1].split()]
        at = [f"y{rng.random()}" for _ in range(rng.randrange(20))]
        rows.append((d, " ".join(at + passage + ["z"] * 3), "s"))
    want = {}
    for r in rows:
        want |= brute.contaminated([r[:2]], [items[r[0] % 20]], None, *CHECKS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = overlaps(decontam.contaminated(documents(spark, rows), bench))
    assert got.items() <= want.items() and len(want) > 50
    assert len(got) >= least * len(want)


def test_exponent(spark):
    sources = [(1000,), (300,), (40,)]
    frame = spark.createDataFrame(sources, "tokens long").withColumn("all", F.lit(1340))
    a = mixing.solve_exponent(frame, max_passes=3.0)
    passes = (1000 / 40) ** (1 - a)
    assert abs(passes - 3.0) < 1e-6
    b = mixing.solve_exponent(frame, entropy=1.0)
    assert abs(mixing._moments(frame, b)[0] - 1.0) < 1e-6
    assert mixing.solve_exponent(frame, max_passes=100.0) == 0.0
    with pytest.raises(ValueError):
        mixing.solve_exponent(frame, entropy=5.0)


def test_mix_budgets(spark, edge_rows):
    rows = [(i, prose(i, 20 + i % 30), f"s{0 if i % 10 < 6 else i % 10}") for i in range(900)]
    out = mixing.mix(documents(spark, rows), max_passes=2.0, block_docs=16).collect()
    size = {r[0]: len(r[1].split()) for r in rows}
    drawn = {}
    for r in out:
        drawn.setdefault(r.source, []).append(r)
    for source, got in drawn.items():
        tokens = sum(size[r[0]] for r in rows if r[2] == source)
        # every document once before any comes again, and no source more often than the limit
        assert {r.doc_id for r in got if r.epoch == 0} == {r[0] for r in rows if r[2] == source}
        assert len({(r.doc_id, r.epoch) for r in got}) == len(got)
        assert sum(size[r.doc_id] for r in got) <= 2 * tokens + 60
        assert [r.epoch for r in sorted(got, key=lambda r: r.position)] == sorted(r.epoch for r in got)
    by_blocks = [r.doc_id for r in sorted(drawn["s0"], key=lambda r: r.position)]
    assert by_blocks != sorted(by_blocks)


def test_mix_edges(spark, edge_rows):
    out = mixing.mix(documents(spark, edge_rows), max_passes=1.5)
    assert out.columns == [c for c in documents(spark, []).columns if c != "epoch"] + ["epoch", "position"]
    rows = out.collect()
    first = [r for r in rows if r.epoch == 0]
    assert sorted(str((r.doc_id, r.text)) for r in first) == sorted(str(r[:2]) for r in edge_rows if brute.words(r[1]))


def test_empty_tables(spark):
    none = documents(spark, [])
    bench = spark.createDataFrame([(1, prose(1, 40))], "item_id long, text string")
    assert quality.apply_quality(none, quality.line_quality(none)).count() == 0
    assert linededup.line_dedup(none).count() == 0
    assert simhash.keep_one(none, simhash.simhash_groups(none)).count() == 0
    assert decontam.decontaminate(none, bench).count() == 0
    assert mixing.mix(none, max_passes=2.0).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.orderBy("doc_id").collect()]
    found = brute.quality(rows, quality.MIN_DOCS, quality.MAX_SHARE, quality.MIN_LEFT)
    texts = [(r[0], v[7]) for r, v in found.items() if v[6]]
    texts = [(d, t) for (d, _), t in zip(texts, brute.line_dedup(texts)) if brute.words(t)]
    texts = [(d, t) for (d, t), (_, _, c) in zip(texts, brute.simhash(texts)) if d == c]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {d for d, _ in brute.contaminated(texts, items, *RULES)}
    want = {d: t for d, t in texts if d not in bad}
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "epoch", "position"]
    got = out.collect()
    assert {(r.doc_id, r.text) for r in got if r.epoch == 0} == set(want.items())
    assert sum(r.epoch == 0 for r in got) == len(want) and {r.doc_id for r in got} == set(want)
    assert all(r.n_chars == len(r.text) for r in got)


def test_pipeline_stages_on_edges(spark, edge_rows):
    import corpus_pipeline

    docs = documents(spark, edge_rows)
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, SF)
        assert name == "temperature_mixing" or out.columns == docs.columns
        out.collect()
        assert step(spark, docs.limit(0), SF).count() == 0


def test_columns_of_null_type_do_not_crash(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())])
    docs = spark.createDataFrame([(None, None, None)] * 3, schema)
    assert quality.line_quality(docs).count() == 3
    assert linededup.line_dedup(docs).count() == 3
    assert simhash.simhash_groups(docs).count() == 3
    assert mixing.mix(docs, entropy=0.0).count() == 0
