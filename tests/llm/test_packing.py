"""Packing against the tokenizers library, a plain dealing loop and an exact round trip."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wakeline.llm import QUERIES, packing

SF = "/root/testdata/sf0.001"
PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True

    def ids(texts):
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    return ids


def test_ids_are_those_of_the_library(spark, plain):
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "\r\n", "a", "word", "Word's", "12", "é", "日本", "\x1c", "\x85", " ", " ", "'ll",
             ".", "!!", "<|endoftext|>", "\U0001f600", "é", "​", ""]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(8000)]
    texts += ["", " ", "x" * 5000, " " * 5000 + "a", "é" * 3000 + " b", "a " * 3000, "\n" * 3000]
    texts += [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    encoder = packing.Encoder(PATH)
    assert encoder.encode(pa.array(texts)) == plain(texts)
    assert encoder.encode(pa.array(texts).slice(100, 9)) == plain(texts[100:109])
    assert encoder.encode(pa.array(["one"])) == plain(["one"])


def slow_deal(sizes, length, width):
    """The same rules, one sequence at a time."""
    rows, sequences = [], 0
    rest = []
    for d, n in enumerate(sizes):
        for start in range(0, n - length + 1, length):
            rows.append((d, start, length, sequences, 0))
            sequences += 1
        rest.append(n % length)
    left = sum(rest) % length
    sizes_of = [length] * (sum(rest) // length) + [2**b for b in range(20, -1, -1) if left & 2**b]
    used, cost = [0] * len(sizes_of), [0] * len(sizes_of)
    for d in sorted(range(len(rest)), key=lambda d: (-rest[d], d)):
        n, start = rest[d], sizes[d] - rest[d]
        while n:
            fits = [s for s in range(len(sizes_of)) if sizes_of[s] - used[s] >= n]
            s = min(fits or [s for s in range(len(sizes_of)) if sizes_of[s] > used[s]], key=lambda s: (cost[s], s))
            part = min(n, sizes_of[s] - used[s])
            rows.append((d, start, part, sequences + s, used[s]))
            used[s] += part
            cost[s] += part * (part + packing.LINEAR * width)
            start, n = start + part, n - part
    return rows, sequences + len(sizes_of)


def test_deal():
    rng = random.Random(2)
    for _ in range(200):
        length = rng.choice([8, 32, 64])
        sizes = [rng.choice([1, 2, rng.randrange(1, 3 * length), length, 2 * length]) for _ in range(rng.randrange(1, 40))]
        rows, n = packing.deal(np.array(sizes), length, 4)
        assert (list(map(tuple, rows.tolist())), n) == slow_deal(sizes, length, 4)


def whole(rows, documents, plain, length=2048):
    """Every token of every document in one piece, sequences without gaps, nothing padded."""
    want = defaultdict(list)
    for (doc_id, _), ids in zip(documents, plain([t or "" for _, t in documents])):
        want[doc_id].append(ids + b"\x01\0\0\0")
    placed, pieces = defaultdict(list), defaultdict(lambda: defaultdict(int))
    for r in rows:
        doc_id, start, n, crc, total, sequence, offset = r
        placed[sequence].append((offset, n))
        options = [x for x in want[doc_id] if len(x) == 4 * total and zlib.crc32(x[4 * start : 4 * (start + n)]) == crc]
        assert options
        pieces[doc_id, total][start] += 1
        pieces[doc_id, total][start + n] -= 1
    for parts in placed.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= length and at & (at - 1) == 0
    for doc_id, texts in want.items():
        for total in {len(x) // 4 for x in texts}:
            copies = sum(len(x) == 4 * total for x in texts)
            assert {k: v for k, v in pieces[doc_id, total].items() if v} == {0: copies, total: -copies}


def test_query_whole_table(spark, plain):
    df = QUERIES["op12_cost_packing"](spark, SF)
    assert df.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    whole(df.collect(), docs, plain)


def test_pack_edges(spark, plain):
    rows = [(None, None), (1, None), (1, ""), (2, "a b c"), (2, "a b c"), (3, "word " * 30_000), (4, " \n"), (None, "z")]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, ids string, start int, offset int")
    for group in (1, 50, 1 << 20):
        packed = packing.pack(docs.repartition(2), PATH, group_tokens=group).withColumn("ids", packing.F.crc32("ids"))
        whole(packed.collect(), rows, plain)
    assert packing.pack(docs.limit(0), PATH).collect() == []
    # a task that runs again gives the same rows
    again = docs.coalesce(1)
    assert sorted(map(str, packing.pack(again, PATH).collect())) == sorted(map(str, packing.pack(again, PATH).collect()))


def test_costs_are_balanced():
    rng = np.random.default_rng(1)
    sizes = np.minimum(rng.lognormal(5, 1, 4000).astype(int) + 1, 2047)
    rows, n = packing.deal(sizes)
    cost = np.bincount(rows[:, 3], rows[:, 2] * (rows[:, 2] + packing.LINEAR * packing.WIDTH), n)
    full = np.bincount(rows[:, 3], rows[:, 2], n) == 2048
    assert cost[full].std() < 0.1 * cost[full].mean()
    assert len(rows) < 1.1 * len(sizes)
