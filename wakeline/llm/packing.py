"""Cost-balanced packing of tokenised documents into sequences of fixed length.

A piece of n tokens costs ``n * (n + LINEAR * width)``: attention grows with the square of a piece, everything else
with its length. Documents are packed group by group: a task gathers documents until they hold ``group_tokens``
tokens, cuts what is longer than a sequence into whole sequences, and deals the rest, largest first, to the sequence
of lowest cost that still has room. The rooms of a group add up to its tokens: sequences of ``length`` and, for the
tokens left over, one sequence for each power of two in their number; so nothing is padded, and a document is cut
only where no sequence has room for it whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

LENGTH = 2048
END = 1
WIDTH = 1024
LINEAR = 6  # 24 w^2 n multiplications outside of attention against 4 w n^2 in it
GROUP_TOKENS = 1 << 20
TEXTS_AT_ONCE, BYTES_AT_ONCE = 2048, 8 << 20
LONG_WORD = 2048  # characters; beyond it a word goes through the tokenizers library
BLANKS_RUN = re.compile(r"\s{2048}")


class Encoder:
    """Token ids of texts as little-endian 32-bit numbers, the ids that ``tokenizers`` gives for a byte-level BPE file.

    A text is cut before each blank that a non-blank follows, where byte-level BPE always has a border. The different
    words of many texts are encoded together, by the ranks of the file's own vocabulary, and the texts are put together
    from them; the file's merges must be in the order of their ids. Names of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        step = spec["pre_tokenizer"]
        if spec["normalizer"] or step["type"] != "ByteLevel" or step["add_prefix_space"] or not step.get("use_regex", True):
            raise ValueError(f"{path}: not a byte-level BPE file without normaliser and prefix")
        vocabulary = spec["model"]["vocab"]
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            raise ValueError(f"{path}: merges are not in the order of their ids")
        to_byte = _byte_of_letter(pre_tokenizers.ByteLevel.alphabet())
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(map(to_byte.get, t)): i for t, i in vocabulary.items() if t not in special}
        # fixed value: the pattern that byte-level BPE files imply
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in ranks.items() if t[:1] == b" "]] = True

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; every chunk of one word is encoded once, however often the texts have it."""
        pieces = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(pieces).to_numpy(zero_copy_only=False)
        coded = pieces.flatten().dictionary_encode()
        index, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        first = np.cumsum(counts) - counts
        heads = [words[i] for i in index[first].tolist()]
        # a piece with a blank at either end is no chunk alone; a text that has one is encoded as it is
        ragged = np.array([not w or w[0].isspace() or w[-1].isspace() for w in words], bool)
        odd = ragged[index]
        odd[first] = [w[-1:].isspace() for w in heads]
        odd = np.logical_or.reduceat(odd, first)
        pool, lengths = self._words(words, ragged)
        alone = [self._text(texts[d].as_py() if o else heads[d]) for d, o in enumerate(odd.tolist())]
        pool = np.concatenate([pool, *alone])
        lengths = np.concatenate([lengths, np.fromiter(map(len, alone), np.int64, len(alone))])
        starts = np.cumsum(lengths) - lengths
        # the entries of each text: its beginning, then its words
        entry, owner = index.astype(np.int64), np.repeat(np.arange(len(texts)), counts)
        keep = ~odd[owner]
        entry[first], keep[first] = len(words) + np.arange(len(texts)), True
        entry, owner = entry[keep], owner[keep]
        n = lengths[entry]
        ids = pool[np.repeat(starts[entry] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        at = np.concatenate([[0], np.cumsum(np.bincount(owner, n, len(texts)).astype(np.int64))]) * 4
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(at.tolist(), at[1:].tolist())]

    def _words(self, words: list[str], ragged: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of " word" for all words, one after the other, and how many each has; none for ragged ones."""
        long = np.fromiter(map(len, words), np.int64, len(words)) >= LONG_WORD
        short = np.flatnonzero(~ragged & ~long)
        ids = self._fast("".join([" " + words[i] for i in short.tolist()]))
        begins = np.flatnonzero(self.opens[ids])
        if len(begins) != len(short):
            raise ValueError("a token begins with a blank inside of a word")
        lengths = np.zeros(len(words), np.int64)
        lengths[short] = np.diff(begins, append=len(ids))
        if not (long := np.flatnonzero(long & ~ragged)).size:
            return ids, lengths
        others = {i: self._text(" " + words[i]) for i in long.tolist()}
        parts = [others.get(i) if i in others else None for i in range(len(words))]
        lengths[long] = [len(x) for x in others.values()]
        spans = np.split(ids, begins[1:]) if len(begins) else []
        for i, span in zip(short.tolist(), spans):
            parts[i] = span
        return np.concatenate([p for p in parts if p is not None]), lengths

    def _fast(self, text: str) -> np.ndarray:
        return np.array(self.fast.encode_ordinary(text), "<u4")

    def _text(self, text: str) -> np.ndarray:
        """Ids of a text as it is; very long words go through the library, whose time does not grow with their square."""
        if len(text) < LONG_WORD or max(map(len, text.split()), default=0) < LONG_WORD and not BLANKS_RUN.search(text):
            return self._fast(text)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")


def _byte_of_letter(alphabet: list[str]) -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves and the others, in order, as U+0100 and on."""
    letters = {ord(c): c for c in alphabet if ord(c) < 256}
    others = iter(sorted(c for c in alphabet if ord(c) >= 256))
    return {letters.get(b) or next(others): b for b in range(256)}


def _portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and number of rows of portions of a few thousand texts or a few megabytes."""
    sizes = pc.binary_length(texts).to_pylist()
    a = held = 0
    for i, n in enumerate(sizes):
        if i > a and (i - a >= TEXTS_AT_ONCE or held + n > BYTES_AT_ONCE):
            yield a, i - a
            a, held = i, 0
        held += n
    if len(sizes) > a:
        yield a, len(sizes) - a


def deal(sizes: np.ndarray, length: int = LENGTH, width: int = WIDTH) -> tuple[np.ndarray, int]:
    """Rows of (document, start, length, sequence, offset) that cut and place documents of ``sizes`` tokens; number of sequences.

    Whole sequences are cut off the front of long documents first. Of equal documents the earlier one is placed first,
    of equally cheap sequences the first is taken. Every sequence ends full.
    """
    cost = lambda n: n * (n + LINEAR * width)
    rows: list[tuple[int, int, int, int, int]] = []
    for d in np.flatnonzero(sizes >= length).tolist():
        for start in range(0, int(sizes[d]) - length + 1, length):
            rows.append((d, start, length, len(rows), 0))
    done = len(rows)
    rest = sizes % length
    total = int(rest.sum())
    left = total % length
    powers = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
    room = np.array([length] * (total // length) + powers, np.int64)
    full = room.copy()
    spent = np.zeros(len(room), np.float64)
    for d in np.lexsort((np.arange(len(rest)), -rest)).tolist():
        n, start = int(rest[d]), int(sizes[d] - rest[d])
        while n:
            fits = np.where(room >= n, spent, np.inf)
            s = int(fits.argmin())
            if fits[s] == np.inf:
                s = int(np.where(room > 0, spent, np.inf).argmin())
            part = min(n, int(room[s]))
            rows.append((d, start, part, done + s, int(full[s] - room[s])))
            room[s] -= part
            spent[s] += cost(part)
            start += part
            n -= part
    return np.array(rows, np.int64).reshape(-1, 5), done + len(room)


def pack(
    docs: DataFrame,
    tokenizer: str,
    length: int = LENGTH,
    end: int = END,
    width: int = WIDTH,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """doc_id, start, length, ids (little-endian 32-bit numbers), doc_tokens, sequence_id, offset: a row a piece.

    ``tokenizer`` is the path of a byte-level BPE file that every executor has; ``end`` follows each document. A null or
    empty text is the end token alone. Rows are documents, whether or not ids are null or repeated. Sequence ids are
    unique: the task's number above, a running number below. Each task packs its own groups without a shuffle, holding
    one group at a time (a very long text makes a group of its own size); a task that runs again gives the same rows.
    Other columns are not read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    id_type = rows.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, first = None, TaskContext.get().partitionId() << 33
        owner, held, tokens = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal first
            sizes = np.fromiter((len(x) // 4 for x in held), np.int64, len(held))
            at, used = deal(sizes, length, width)
            d, start, n, sequence, offset = at.T
            ids = [held[i][4 * s : 4 * (s + k)] for i, s, k in zip(d.tolist(), start.tolist(), n.tolist())]
            owners = pa.concat_arrays(owner).take(pa.array(d))
            columns = [owners, *map(pa.array, (start, n)), pa.array(ids, pa.binary()), *map(pa.array, (sizes[d], sequence + first, offset))]
            first += used
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            encoder = encoder or Encoder(tokenizer)
            for a, size in _portions(batch.column(1)):
                b = a
                for k, ids in enumerate(encoder.encode(batch.column(1).slice(a, size))):
                    held.append(ids + end.to_bytes(4, "little"))
                    tokens += len(ids) // 4 + 1
                    if tokens >= group_tokens:
                        owner.append(batch.column(0).slice(b, a + k + 1 - b))
                        yield flush()
                        owner, held, tokens, b = [], [], 0, a + k + 1
                owner.append(batch.column(0).slice(b, a + size - b))
        if held:
            yield flush()

    schema = f"doc_id {id_type.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(run, schema)
