"""Packing of tokenised documents into windows by Karmarkar-Karp multiway differencing.

A task tokenises its documents in input order and packs them block by block; nothing is shuffled.
What a document has beyond whole windows joins the block's items. Differencing starts from one
partial partition per item, and merges the two with the greatest imbalances, the fullest windows
of one with the emptiest of the other, until one partition of near-equal windows is left. The
window count rises whenever a window exceeds its capacity, and the block is differenced again; only
then, to fill the padding, are the emptiest windows cut up. Windows depend on how the input is split
into tasks, and on nothing else: a task that is run again gives the same rows.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches

WINDOW = 2048
#: Tokens in a block. At most one window's worth is padding in each.
BLOCK_TOKENS = 1 << 19
#: Words whose ids a worker keeps.
CACHED_WORDS = 250_000
#: Characters of an odd text from which cutting it is quicker than encoding it whole.
CUT_FROM = 4096
END = (1).to_bytes(4, "little")
#: How byte-level BPE splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ODD = re.compile("[^\t\n\r -~\xa1-ɏ]|\\s\\s")


class _Words(dict):
    """Ids of " " + word as packed bytes."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        out = self.encode(" " + word)
        if len(self) < CACHED_WORDS:
            self[word] = out
        return out


def ordinary(path: str) -> Callable[[str], bytes]:
    """The ids, packed, of a text without rare characters: the same merges by a quicker library."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"] for t in told["added_tokens"]}
    ranks = {bytes(of[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in special}
    encode = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: struct.pack(f"<{len(ids := encode(text))}I", *ids)


@lru_cache(maxsize=1)
def _libraries(path: str) -> tuple[Callable[[str], bytes], _Words]:
    """Any text's packed ids, and words' ids: a worker's tasks share them, as most words are met in
    every task."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), _Words(ordinary(path))


def tokenizer(path: str) -> Callable[[str], bytes]:
    """text -> its ids as little-endian unsigned 32-bit numbers, as the byte-level BPE file at
    `path` has them (strings of special tokens count as ordinary text).

    Its rule for splitting never joins what a single space separates, so words are encoded once
    and looked up; texts with other white space or rare characters are encoded whole."""
    encode, words = _libraries(path)

    def run(text: str) -> bytes:
        if not text:
            return b""
        if _ODD.search(text):
            # around a run of spaces or a rare character the rule looks further than one word, so words
            # can't be looked up; a short text isn't worth cutting, and gives the same ids either way:
            # the rule always parts before a single space between two printable characters
            return encode(text) if len(text) < CUT_FROM or text.isspace() else _pieces(text)
        first, *rest = text.split(" ")
        return (encode(first) if first else b"") + b"".join(map(words.__getitem__, rest))

    def _pieces(text: str) -> bytes:
        """A long odd text, cut before single spaces between two printable ASCII characters."""
        cuts = [0, *(m.start() + 1 for m in re.finditer(r"[!-~](?= [!-~])", text)), len(text)]
        out, at = [], 0
        for c in cuts[1:]:
            part = text[at:c]
            if part[:1] == " " and len(part) < 64 and not _ODD.search(part):
                out.append(words[part[1:]])
                at = c
            elif c - at:
                out.append(encode(part))
                at = c
        return b"".join(out)

    return run


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """k groups of the indices of sizes, with sums as near to equal as differencing gets."""
    if k <= 1:
        return [list(range(len(sizes)))]
    if not sizes:
        return [[] for _ in range(k)]
    # a partial partition holds its nonzero windows only, in rising order; the rest are empty
    heap, state, count = [], {}, 0
    for i, s in enumerate(sizes):
        state[count] = (np.array([s], dtype=np.int64), [[i]])
        heap.append((-s, count))
        count += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        a_sums, a_sets = state.pop(heapq.heappop(heap)[1])
        b_sums, b_sets = state.pop(heapq.heappop(heap)[1])
        if len(a_sums) + len(b_sums) <= k:
            sums, sets = np.concatenate([a_sums, b_sums]), a_sets + b_sets
        else:
            # a's fullest with b's emptiest: of k windows in opposite order, only `both` overlap
            both = len(a_sums) + len(b_sums) - k
            sums = np.concatenate([a_sums[both:], a_sums[:both] + b_sums[:both][::-1], b_sums[both:]])
            sets = a_sets[both:] + [x + y for x, y in zip(a_sets[:both], b_sets[:both][::-1])] + b_sets[both:]
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        state[count] = (sums, [sets[j] for j in order.tolist()])
        low = 0 if len(sums) < k else int(sums[0])
        heapq.heappush(heap, (low - int(sums[-1]), count))
        count += 1
    sets = state[heap[0][1]][1]
    return [[] for _ in range(k - len(sets))] + sets


def pack(sizes: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (item, start, length); every size is at least 1 and at most `window`.

    The items are differenced into as few windows as could hold them, and while one exceeds its
    capacity, into more. The emptiest windows, those above the least number, are then cut up to fill
    the padding of the others, so that at most one window's worth of padding is left."""
    least = max(1, -(-sum(sizes) // window))
    k = least
    while True:
        groups = difference(sizes, k)
        loads = [sum(sizes[i] for i in g) for g in groups]
        if max(loads) <= window:
            break
        # by what is in excess, and by half of what it has risen already, so that a few times will do
        k += max(1, 4 * sum(max(0, n - window) for n in loads) // window, (k - least) // 2)
    order = sorted(range(k), key=lambda j: (-loads[j], j))
    windows = [[(i, 0, sizes[i]) for i in sorted(groups[j], key=lambda i: (sizes[i], i))] for j in order]
    room = [j for j in range(least) if loads[order[j]] < window]
    free = [window - loads[j] for j in order]
    for item, start, length in (piece for w in windows[least:] for piece in w):
        while length:
            j = room[-1]
            n = min(length, free[j])
            windows[j].append((item, start, n))
            free[j], start, length = free[j] - n, start + n, length - n
            if not free[j]:
                room.pop()
    return [w for w in windows[:least] if w]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces(docs: DataFrame, path: str, text: str = "text", window: int = WINDOW, block: int = BLOCK_TOKENS) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document ends with id 1, so null and empty texts are one token long. Repeated rows and
    null ids are packed like any others; an empty table gives no rows; other columns are not
    looked at. Documents longer than a window give whole windows and a rest."""

    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        sequence = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        items: list[tuple] = []  # doc_id, ids left, start of them, doc_tokens
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal sequence, rows, items, held
            for w in pack([len(x[1]) // 4 for x in items], window) if items else []:
                offset = 0
                for i, s, n in w:
                    doc, ids, start, tokens = items[i]
                    rows.append((doc, start + s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), tokens, sequence, offset))
                    offset += n
                sequence += 1
            cols = list(zip(*rows)) or [[]] * 7
            rows, items, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for b in batches:
            for doc, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(body or "") + END
                tokens, at = len(ids) // 4, 0
                while tokens - at >= window:
                    rows.append((doc, at, window, zlib.crc32(ids[4 * at : 4 * (at + window)]), tokens, sequence, 0))
                    sequence += 1
                    at += window
                if at < tokens:
                    items.append((doc, ids[4 * at :], at, tokens))
                    held += tokens - at
                if held >= block:
                    yield close()
        if items or rows:
            yield close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(work, SCHEMA)
