"""Filter interaction audit: which documents each of five filters removes, in every order of the filters.

Four filters look at a text alone; the fifth fails a document whose text a document of smaller id has too. For it,
texts are range-partitioned by adaptive prefixes: a range is all texts with one prefix, and a prefix under which too
many bytes stand is lengthened until they part. Each task inserts its texts into a compressed radix trie whose
terminals hold their documents. A trie of the scanning task comes first, so that of many copies one text a task
moves; the trie of the range then has the smallest id of each text and flags the other documents. Failed filters are
bits of a mask, and all orders are counted from one small table of masks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from wakeline.session import stage

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT = 50  # per cent
MAX_UPPER = 3  # per cent
SYMBOLS = b"#$%&*|"
DUPLICATE = 1 << FILTERS.index("E")
ROW_BYTES = 64  # what a document weighs besides its text
RANGE_BYTES = 64 << 20  # texts of one task; the number of tasks follows
HELD_BYTES = 32 << 20  # texts in the trie of a scanning task, which then begins a new one
SHORTEST = 8  # characters of the first prefixes; each longer one has four times as many
_UPPER, _TAIL = bytes(range(65, 91)), bytes(range(0x80, 0xC0))


def text_mask(text: bytes) -> int:
    """Bits of the failed filters A to D for a UTF-8 text."""
    words = text.split()
    points = len(text.translate(None, _TAIL))
    upper = len(text) - len(text.translate(None, _UPPER))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1
        | (100 * upper > MAX_UPPER * points) << 2
        | (len(text) != len(text.translate(None, SYMBOLS))) << 3
    )


class Trie:
    """Compressed radix trie of byte strings; a node is [label, children or None, documents or None]."""

    def __init__(self):
        self.root: list = [b"", None, None]

    def insert(self, text: bytes, document: tuple) -> int:
        """Adds ``document`` at the terminal of ``text``; the bytes that were new."""
        node, at, new = self.root, 0, 0
        while at < len(text):
            if node[1] is None:
                node[1] = {}
            child = node[1].get(text[at])
            if child is None:
                child = node[1][text[at]] = [text[at:], None, None]
                new = len(text) - at
            elif not text.startswith(child[0], at):
                k = _shared(child[0], text, at)
                upper = [child[0][:k], {child[0][k]: child}, None]
                node[1][text[at]] = upper
                child[0] = child[0][k:]
                child = upper
            at += len(child[0])
            node = child
        if node[2] is None:
            node[2] = []
        node[2].append(document)
        return new

    def terminals(self) -> Iterator[tuple[bytes, list[tuple]]]:
        stack = [(b"", self.root)]
        while stack:
            above, node = stack.pop()
            text = above + node[0]
            if node[2] is not None:
                yield text, node[2]
            if node[1] is not None:
                stack.extend((text, child) for child in node[1].values())


def _shared(label: bytes, text: bytes, at: int) -> int:
    """How many bytes ``label`` shares with ``text`` from ``at`` on."""
    k, step, size = 0, 16, min(len(label), len(text) - at)
    while k < size:
        n = min(step, size - k)
        differ = int.from_bytes(label[k : k + n]) ^ int.from_bytes(text[at + k : at + k + n])
        if differ:
            return k + n - (differ.bit_length() + 7) // 8
        k, step = k + n, step * 2
    return size


def _flagged(documents: list[tuple]) -> Iterator[tuple[bool, tuple]]:
    """Whether each document of a text comes after the smallest id; a document without an id neither is one nor has one."""
    least = min((d[0] for d in documents if d[0] is not None), default=None)
    for d in documents:
        yield d[0] is not None and d[0] > least, d


def _prefix(length: int) -> Column:
    return F.xxhash64(F.substring("text", 1, length))


def text_ranges(texts: DataFrame, tasks: int, range_bytes: int = RANGE_BYTES) -> tuple[list[DataFrame], int]:
    """For each prefix length, the hashes of the prefixes that are too heavy and so go by the next length; number of tasks.

    ``texts`` has ``text``, not null. A prefix is heavy with more than a quarter of what a task should get, so there are
    at most 4 x tasks heavy ones of each length: rows of eight bytes, fit for a broadcast. A prefix that holds
    whole texts only is not lengthened. Two prefixes of one hash share a range, which does no harm.
    """
    weight = F.sum(F.octet_length("text") + F.lit(ROW_BYTES)).alias("w")
    now = texts.groupBy(_prefix(SHORTEST).alias("h")).agg(weight, F.max(F.char_length("text")).alias("longest"))
    now = stage(now, "prefixes")
    total = now.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    tasks = max(tasks, -(-total // range_bytes))
    heavy, length = [], SHORTEST
    while True:
        found = stage(now.where((F.col("w") > total / (4 * tasks)) & (F.col("longest") > length)).select("h"), "heavy")
        if found.isEmpty():
            return heavy, tasks
        heavy.append(found)
        under = texts.withColumn("h", _prefix(length)).join(F.broadcast(found), "h", "left_semi")
        length *= 4
        now = under.groupBy(_prefix(length).alias("h")).agg(weight, F.max(F.char_length("text")).alias("longest"))


def _with_range(texts: DataFrame, heavy: list[DataFrame]) -> DataFrame:
    ranged, length = texts.withColumn("range", _prefix(SHORTEST)), SHORTEST
    for found in heavy:
        length *= 4
        marked = ranged.join(F.broadcast(found.select(F.col("h").alias("range"), F.lit(True).alias("deep"))), "range", "left")
        ranged = marked.withColumn("range", F.when(F.col("deep"), _prefix(length)).otherwise(F.col("range"))).drop("deep")
    return ranged


def filter_masks(docs: DataFrame, held_bytes: int = HELD_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, part (the language, null: empty string) and mask (bits of the failed filters) of every row.

    A null text is empty; empty texts are copies of each other. Rows without an id are no duplicates and have none.
    Rows that repeat an id are judged each by its own text; equal ids do not make each other duplicates. Very long
    texts are inserted whole. Other columns are not read; an empty table gives no rows.
    """
    body = F.coalesce("text", F.lit(""))
    texts = docs.select(body.alias("text"))
    spark = docs.sparkSession
    heavy, tasks = text_ranges(texts, int(spark.conf.get("spark.sql.shuffle.partitions")), range_bytes)
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), body.alias("text"))
    rows = _with_range(rows, heavy).select("doc_id", "part", "range", F.col("text").cast("binary").alias("text"))
    id_type = rows.schema["doc_id"].dataType
    kind = id_type.simpleString()
    names = ["doc_id", "part", "mask", "range", "text"]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the copies that a task has, the first id's keep their text; the others are known to be duplicates."""
        trie, held, spread = Trie(), 0, TaskContext.get().partitionId() << 32

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal spread
            out = []
            for text, documents in trie.terminals():
                mask = text_mask(text)
                for after, (doc_id, part, key) in _flagged(documents):
                    if after or doc_id is None:
                        spread += 1
                        out.append((doc_id, part, mask | (DUPLICATE if after else 0), spread, None))
                    else:
                        out.append((doc_id, part, mask, key, text))
            for a in range(0, len(out), 4096):
                yield _batch(out[a : a + 4096], id_type, names)

        for b in batches:
            for doc_id, part, key, text in zip(*(c.to_pylist() for c in b.columns)):
                held += trie.insert(text, (doc_id, part, key)) + ROW_BYTES
                if held >= held_bytes:
                    yield from flush()
                    trie, held = Trie(), 0
        yield from flush()

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts of a task's ranges meet in one trie; its terminals have the smallest id of each text."""
        trie = Trie()
        for b in batches:
            known = []
            for doc_id, part, mask, _, text in zip(*(c.to_pylist() for c in b.columns)):
                if text is None:
                    known.append((doc_id, part, mask))
                else:
                    trie.insert(text, (doc_id, part, mask))
            if known:
                yield _batch(known, id_type, names[:3])
        out = []
        for _, documents in trie.terminals():
            out += [(d, part, mask | (DUPLICATE if after else 0)) for after, (d, part, mask) in _flagged(documents)]
        if out:
            yield _batch(out, id_type, names[:3])

    moved = rows.mapInArrow(local, f"doc_id {kind}, part string, mask int, range long, text binary")
    dealt = moved.repartition(tasks, "range")
    return dealt.mapInArrow(ranged, f"doc_id {kind}, part string, mask int")


def _batch(rows: list[tuple], id_type, names: list[str]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(id_type), pa.string(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def interactions(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of the filters and step: documents kept, removed, redundant, and what their labels say.

    ``labels`` has doc_id, quality and toxic; a document is good or toxic if any of its rows says 1. Documents without
    an id or a label are neither. Repeated rows count as often as they stand. Parts come from the masks; without any
    there are no rows.
    """
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"),
    )
    # rows of one id become one before they meet the labels
    once = masks.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    counts = once.join(said, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )
    steps = []
    for order in permutations(FILTERS):
        bits = [1 << FILTERS.index(f) for f in order]
        for k, bit in enumerate(bits):
            one = (F.lit("".join(order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(bit).alias("bit"))
            steps.append(F.struct(*one, F.lit(sum(bits[:k])).alias("before")))
    # every part has 600 rows for each of its masks, 32 at most
    grid = counts.select("part", "mask", "n", "good", "toxic", F.explode(F.array(*steps)).alias("s")).select("*", "s.*")
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    here = F.col("mask").bitwiseAND(F.col("before")) == 0
    total = lambda when, value="n": F.sum(F.when(when, F.col(value)).otherwise(F.lit(0))).cast("long")
    # of the orders of a mask's filters, the same share begins with each of them
    first = F.expr("n * 120 div bit_count(mask)")
    return grid.groupBy("part", "filter_order", "step").agg(
        total(here & ~fails).alias("kept"),
        total(here & fails).alias("removed"),
        total(~here & fails).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(here & fails, "good").alias("good_lost"),
        total(here & fails, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, first).otherwise(F.lit(0))).cast("long").alias("shapley"),
    )
