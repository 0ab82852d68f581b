"""Periodic runs in texts by an online sparse diagonal DP over earlier occurrences.

A run of period q is a maximal stretch of words in which words q apart are identical, q its smallest period. On
the diagonal of lag q it is a chain of matches at least max(q, least - q) words long. Lags are taken in octaves
[m, 2m), and in an octave a word counts as an earlier occurrence only where the m words from it on agree, which
every run of that octave grants. Going through the words once, each occurrence lengthens the active match of its
lag; a lag that the next word does not continue has ended, and is told if it is long enough. Pairs that lie inside
one known run of a smaller period are multiples of that period and are passed over, so a text of one repeated word
takes a few steps a word.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LEAST = 12


def periodic_runs(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least max(least, 2 * period) words, by start, then period.

    Exact: words are numbered and blocks are named by pairs of shorter names. Hashes only tell texts in which no
    block of the shortest length can repeat.
    """
    n, match = len(words), max(1, -(-least // 2))
    if n < max(least, 2) or not _may_repeat(words, match):
        return []
    number: dict = {}
    names = {1: np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)}
    low, high = 1, 1 << match.bit_length()
    known: dict[int, list[tuple[int, int]]] = {}
    while 2 * low <= n and match <= n:
        block = _blocks(names, match)
        inside, within = _covered(known, len(block), match)
        at = _paired(block, inside, low, high)
        if at is None:
            break  # longer blocks do not repeat either
        ended = _octave(at.tolist(), block[at].tolist(), inside[at].tolist(), within, low, high, match, least)
        # a stretch inside a run whose period divides its lag has that smaller period
        for q, a, b in sorted(ended):
            if not any(q % d == 0 and _holds(runs, a, b) for d, runs in known.items()):
                known.setdefault(q, []).append((a, b))
        low = match = high
        high *= 2
    return sorted((a, b - a, q) for q, runs in known.items() for a, b in runs)


def _may_repeat(words: list, size: int) -> bool:
    """False only if no ``size`` consecutive words occur twice; equal words have equal hashes."""
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    m = len(h) - size + 1
    mixed = h[:m].copy()
    for k in range(1, size):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += h[k : k + m]
    mixed.sort()
    return bool((mixed[1:] == mixed[:-1]).any())


def _covered(known: dict[int, list[tuple[int, int]]], blocks: int, match: int) -> tuple[np.ndarray, list | None]:
    """For the block at each position: the first start of a known run round it; and the run of at most half its
    length round it, which is one at most, or None."""
    inside, within = np.arange(blocks), None
    for period, runs in known.items():
        for a, b in runs:
            if b - a >= match:
                np.minimum(inside[a : b - match + 1], a, out=inside[a : b - match + 1])
                if 2 * period <= match:
                    within = within or [None] * blocks
                    within[a : b - match + 1] = [(a, b)] * (b - match + 1 - a)
    return inside, within


def _blocks(names: dict[int, np.ndarray], size: int) -> np.ndarray:
    """A number for the ``size`` words from each position on, equal for equal words."""
    half = 1
    while 2 * half <= size:
        if 2 * half not in names:
            names[2 * half] = _pairs(names[half], half)
        half *= 2
    return _pairs(names[half], size - half) if size > half else names[half]


def _pairs(name: np.ndarray, apart: int) -> np.ndarray:
    left, right = name[: len(name) - apart], name[apart:]
    return np.unique(left * (right.max() + 1) + right, return_inverse=True)[1]


def _paired(block: np.ndarray, inside: np.ndarray, low: int, high: int) -> np.ndarray | None:
    """Positions, in order, whose block may stand ``low`` to ``high`` words apart elsewhere; None if no block repeats.

    Left out are those with no equal block within ``high`` words on either side, and blocks that stand nowhere but
    within ``low`` words or in one known run.
    """
    order = np.argsort(block, kind="stable")
    new = np.ones(len(block) + 1, bool)
    new[1:-1] = block[order[1:]] != block[order[:-1]]
    if new.all():
        return None
    gap = np.full(len(block) + 1, high)
    gap[1:-1] = np.diff(order)
    gap[new] = high
    first, last = order[new[:-1]], order[new[1:]]
    wide = (last - first >= low) & (inside[last] > first)
    near = (gap[1:] < high) | (gap[:-1] < high)
    return np.sort(order[near & wide[np.cumsum(new[:-1]) - 1]])


def _octave(
    at: list[int], block: list[int], inside: list[int], within: list | None, low: int, high: int, match: int, least: int
) -> list[tuple[int, int, int]]:
    """(lag, start, end) of the stretches on lags [low, high).

    ``inside`` and ``within`` are those of ``_covered``. Where equal blocks lie in two runs of one small period that
    do not touch, a match ends where either run does; so only lags that lay their starts or their ends on each other
    can go on, and the other pairs of the two runs are passed over.
    """
    occurrences: dict[int, list[int]] = {}
    active: dict[int, int] = {}  # lag: where its match began
    ended, last = [], -2

    def end(lags: dict[int, int], still: dict[int, int]) -> None:
        for q, s in lags.items():
            if q not in still:
                length = last + match - s
                if length >= q and length + q >= least:
                    ended.append((q, s - q, last + match))

    for i, b, known_from in zip(at, block, inside):
        if active and i != last + 1:
            end(active, {})
            active = {}
        earlier = occurrences.get(b)
        now: dict[int, int] = {}
        if earlier is None:
            occurrences[b] = [i]
        else:
            newest, oldest = min(i - low, known_from - 1), i - high
            k, mine = bisect_right(earlier, newest) - 1, within[i] if within else None
            while k >= 0 and (j := earlier[k]) > oldest:
                if mine and (run := within[j]) and run is not mine and run[1] < mine[0]:
                    for lag in (mine[0] - run[0], mine[1] - run[1]):
                        if low <= lag < high and _has(earlier, i - lag):
                            now[lag] = active.get(lag, i)
                    k = bisect_left(earlier, run[0]) - 1
                    continue
                now[i - j] = active.get(i - j, i)
                k -= 1
            earlier.append(i)
        if active:
            end(active, now)
        active, last = now, i
    end(active, {})
    return ended


def _has(ordered: list[int], x: int) -> bool:
    k = bisect_left(ordered, x)
    return k < len(ordered) and ordered[k] == x


def _holds(runs: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether one of the runs of a period, ordered by start and none inside another, holds [a, b)."""
    k = bisect_left(runs, (a + 1,)) - 1
    return k >= 0 and runs[k][1] >= b


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def find_runs(
    docs: DataFrame, least: int = LEAST, alter: Callable[[int | None, list[bytes]], list[bytes]] | None = None
) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period) and text (collapsed, one blank between words), a row a row.

    Words are ``[^\\x20\\x09-\\x0D]+``; ``alter`` may replace a document's words before the search. Null and empty texts
    have no words, no runs and an empty text; ids may be null or repeated, each row is read by itself. Other columns
    are not read. A task holds one text at a time; the work follows the words and their matching pairs. No shuffle.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    span = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, runs, texts = [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = text.as_py().split()
                if alter:
                    words = alter(doc_id, words)
                found = periodic_runs(words, least)
                sizes.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                texts.append(b" ".join(collapsed(words, found)))
            cols = [b.column(0), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(span)), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "runs", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, text string"
    return rows.mapInArrow(run, schema)
