"""SimHash fingerprints and their near-duplicate groups by a binary trie self-join.

Fingerprints collapse to distinct values before they move. Two values within d bits agree in one of d + 1
bit blocks, so each block's value is a root of tries; below a root, pairs of trie nodes are traversed
together and dropped as soon as their differing bits exceed the budget. Roots with very many values are cut
into pairs of subtries, each pair a root of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from wakeline.session import stage

from .components import components

BITS = 64
SHINGLE = 4
MAX_BITS = 4
HOT_ROOT = 100_000  # values under one root in one task; beyond it the root is cut, with equal results
CUT_BITS = 8
FRONTIER = 1 << 20
LEAF_PAIRS = 64


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """64-bit SimHash over k-word shingles, repeats included; zero for a text without words."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    line = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    ends = ends.tolist()
    hash64 = partial(xxhash.xxh64_intdigest, seed=42)
    if len(w) <= k:
        hashes = [hash64(line)]
    else:
        hashes = [hash64(line[s:e]) for s, e in zip(starts, ends[k - 1 :])]
    n = len(hashes)
    # blocks bound the memory of the unpacked bits for very long texts
    data, ones = np.array(hashes, dtype="<u8").view(np.uint8).reshape(n, 8), np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(data[at : at + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, th (hash of the text) and fp (the fingerprint as a signed long) of every row."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), k) for t in b.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["doc_id", "th", "fp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, th long, fp long")


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of max_bits + 1 blocks."""
    cuts = np.linspace(0, BITS, max_bits + 2).round().astype(int).tolist()
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


class TrieJoin:
    """Links between the values of many tries, held as one sorted array in which a node is a range."""

    def __init__(self, keys: np.ndarray, max_bits: int):
        self.keys, self.max_bits = keys, max_bits
        self.label = np.arange(len(keys))

    def run(self, bit: int, pairs: np.ndarray) -> None:
        """``pairs``: columns a_lo, a_hi, b_lo, b_hi, distance of node pairs whose bits above ``bit`` are counted."""
        todo = [(bit, pairs)]
        while todo:
            bit, pairs = todo.pop()
            if not len(pairs):
                continue
            # subtries whose remaining bits cannot exceed the budget are linked whole
            whole = pairs[:, 4] + bit + 1 <= self.max_bits
            if whole.any():
                self._star(pairs[whole])
                pairs = pairs[~whole]
            small = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= LEAF_PAIRS
            if small.any():
                self._leaves(pairs[small])
                pairs = pairs[~small]
            if not len(pairs):
                continue
            if len(pairs) > FRONTIER:
                todo += [(bit, p) for p in np.array_split(pairs, 4)]
                continue
            todo.append((bit - 1, self._children(bit, pairs)))

    def _children(self, bit: int, p: np.ndarray) -> np.ndarray:
        one = ((self.keys >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)
        count = np.concatenate([[0], np.cumsum(one)])

        def mid(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            return hi - (count[hi] - count[lo])

        am, bm = mid(p[:, 0], p[:, 1]), mid(p[:, 2], p[:, 3])
        a0, a1 = (p[:, 0], am), (am, p[:, 1])
        b0, b1 = (p[:, 2], bm), (bm, p[:, 3])
        d, own = p[:, 4], p[:, 0] == p[:, 2]
        parts = [
            np.stack([*a0, *b0, d], 1),
            np.stack([*a1, *b1, d], 1),
            np.stack([*a0, *b1, d + 1], 1),
            np.stack([*a1, *b0, d + 1], 1)[~own],
        ]
        out = np.concatenate(parts)
        fine = (out[:, 0] < out[:, 1]) & (out[:, 2] < out[:, 3]) & (out[:, 4] <= self.max_bits)
        lone = (out[:, 0] == out[:, 2]) & (out[:, 1] - out[:, 0] == 1)
        return out[fine & ~lone]

    def _leaves(self, p: np.ndarray) -> None:
        for part in np.array_split(p, len(p) * LEAF_PAIRS // (1 << 22) + 1):
            wide = part[:, 3] - part[:, 2]
            n = (part[:, 1] - part[:, 0]) * wide
            row = np.repeat(np.arange(len(part)), n)
            off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = part[row, 0] + off // wide[row], part[row, 2] + off % wide[row]
            near = np.bitwise_count(self.keys[i] ^ self.keys[j]) <= self.max_bits
            self._link(i[near], j[near])

    def _star(self, p: np.ndarray) -> None:
        for lo, hi in ((p[:, 0], p[:, 1]), (p[:, 2], p[:, 3])):
            n = hi - lo
            row = np.repeat(np.arange(len(p)), n)
            i = lo[row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            self._link(i, p[row, 0])

    def _link(self, i: np.ndarray, j: np.ndarray) -> None:
        """Hook the components of i and j; only the forest of labels is kept, never the pairs."""
        label = self.label
        while True:
            a, b = label[i], label[j]
            live = a != b
            if not live.any():
                return
            i, j, a, b = i[live], j[live], a[live], b[live]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


def _join_roots(max_bits: int):
    """Arrow batches of (block, cut, mask, fp), complete roots only -> (a, b) links that span each root's groups."""
    blocks = _blocks(max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [[np.asarray(c) for c in b.columns] for b in batches if b.num_rows]
        if not cols:
            return
        block, cut, mask, fp = (np.concatenate(c) for c in zip(*cols))
        fp = fp.view(np.uint64)
        for at, (start, width) in enumerate(blocks):
            for cut_bits in (0, CUT_BITS):
                mine = (block == at) & (cut == cut_bits)
                if mine.any():
                    yield from _one(fp[mine], mask[mine], start, width + cut_bits, width, max_bits)

    return run


def _one(fp: np.ndarray, mask: np.ndarray, start: int, fixed: int, width: int, max_bits: int):
    turned = (fp << np.uint64(start)) | (fp >> np.uint64(BITS - start)) if start else fp
    top = turned >> np.uint64(BITS - fixed)
    m = mask.astype(np.uint64)
    root = np.minimum(top, top ^ m)  # both subtries of a pair have one root
    order = np.lexsort((turned, m, root))
    turned, root, m, top = turned[order], root[order], m[order], top[order]
    edge = np.flatnonzero(np.r_[True, (root[1:] != root[:-1]) | (m[1:] != m[:-1])])
    ends = np.r_[edge[1:], len(root)]
    side = np.concatenate([[0], np.cumsum(top == root)])
    middle = edge + side[ends] - side[edge]
    own = m[edge] == 0
    pairs = np.stack(
        [
            edge,
            np.where(own, ends, middle),
            np.where(own, edge, middle),
            ends,
            np.bitwise_count(m[edge]).astype(np.int64),
        ],
        1,
    ).astype(np.int64)
    pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3])]
    pairs = pairs[~((pairs[:, 0] == pairs[:, 2]) & (pairs[:, 1] - pairs[:, 0] == 1))]
    join = TrieJoin(turned, max_bits)
    join.run(BITS - fixed - 1, pairs)
    fp = fp[order]
    far = np.flatnonzero(join.label != np.arange(len(fp)))
    if len(far):
        a, b = fp[far].view(np.int64), fp[join.label[far]].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def trie_links(values: DataFrame, max_bits: int = MAX_BITS, hot_root: int = HOT_ROOT) -> DataFrame:
    """Links (a, b) over distinct fingerprints ``fp`` that connect exactly the groups within ``max_bits`` bits."""
    blocks = _blocks(max_bits)
    value = [
        F.shiftrightunsigned(F.shiftleft("fp", start) if start else F.col("fp"), BITS - width) for start, width in blocks
    ]
    rows = values.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(i).alias("block"), v.alias("root")) for i, v in enumerate(value)])).alias("r"),
    ).select("fp", "r.*")
    hot = rows.groupBy("block", "root").count().where(F.col("count") > hot_root).select("block", "root", F.lit(CUT_BITS).alias("cut"))
    rows = rows.join(stage(hot, "roots"), ["block", "root"], "left")
    # a cut root: each value goes to every pair of subtries that holds its own and stays within the budget
    masks = [m for m in range(1 << CUT_BITS) if m.bit_count() <= max_bits]
    nexts = F.lit(0).cast("long")
    for i, (start, width) in enumerate(blocks):
        turn = start + width
        up = F.shiftleft("fp", turn % BITS) if turn % BITS else F.col("fp")
        nexts = F.when(F.col("block") == i, F.shiftrightunsigned(up, BITS - CUT_BITS)).otherwise(nexts)
    rows = rows.select(
        "block",
        "root",
        F.coalesce("cut", F.lit(0)).alias("cut"),
        nexts.alias("next"),
        F.explode(F.when(F.col("cut").isNull(), F.array(F.lit(0))).otherwise(F.array(*map(F.lit, masks)))).alias("mask"),
        "fp",
    )
    low = F.when(F.col("cut") == 0, F.lit(0)).otherwise(F.least("next", F.expr("next ^ mask")))
    rows = rows.withColumn("low", low).repartition("block", "root", "low", "mask")
    return rows.select("block", "cut", "mask", "fp").mapInArrow(_join_roots(max_bits), "a long, b long")


def simhash_groups(docs: DataFrame, k: int = SHINGLE, max_bits: int = MAX_BITS, hot_root: int = HOT_ROOT) -> DataFrame:
    """doc_id, th, fp, component_id for every row of ``docs``.

    component_id is the smallest non-null doc_id reachable over links of at most ``max_bits`` bits. Null and
    empty texts have fingerprint zero and link like any other. Equal fingerprints, however many, are one
    value. An empty table gives an empty result; other columns are not read.
    """
    prints = stage(fingerprints(docs, k), "prints")
    values = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "values")
    groups = components(stage(trie_links(values, max_bits, hot_root), "links"))
    roots = values.join(groups.withColumnRenamed("node", "fp"), "fp", "left")
    roots = roots.withColumn("root", F.coalesce("root", "fp"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    per_value = roots.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(per_value, "fp", "left").select("doc_id", "th", "fp", "component_id")


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of each group: the one with the smallest id; of rows with that id, the smallest text hash, once.

    Of rows in groups without any id, one of each fingerprint stays.
    """
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    nameless = F.when(F.col("doc_id").isNull(), F.col("fp"))
    first = first.groupBy("doc_id", nameless.alias("fp")).agg(F.min("th").alias("th"))
    first = first.select(F.struct("doc_id", "th").alias("key"))
    rows = docs.select(
        F.struct("*").alias("row"),
        F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).alias("key"),
    ).join(first, "key", "left_semi")
    return rows.dropDuplicates(["key"]).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
