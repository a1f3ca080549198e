"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice.

A text's lattice has an arc for every vocabulary piece at every place it fits, weighted by a power
of the piece's rank; a character that no piece covers has one arc of byte pieces. Forward sums of
path weights are computed once for each different word (no piece crosses the start of a run of
spaces, or a line break, so the lattice falls apart there and its parts are independent), and all
words' paths are sampled backwards in step, one random number per step, drawn from a hash of the
row's key, the word's place and the step. The same row gives the same segmentation anywhere.
Nothing is normalised, so decoding gives back the text to the byte.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of words whose lattices a worker keeps before it starts anew; documents and characters
#: handled at once (a longer text is handled by itself). They change nothing in the result.
KEPT, ROWS, CHARS = 3_000_000, 1000, 4_000_000
_WORD = re.compile(r"\n| *[^ \n]+| +")
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64 of unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(_MIX[0])
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
        return x ^ (x >> np.uint64(31))


#: An arc's node takes it for draws up to `last` beyond those of its arcs before; back: the node that
#: it comes from (-1: the word's start).
_ARC = np.dtype([("last", np.uint32), ("back", np.int32), ("code", np.int32)])


class _Growing:
    """An array that grows at its end; its room doubles, so adding is cheap."""

    def __init__(self, kind: object):
        self.held, self.size = np.empty(1024, dtype=kind), 0

    def __len__(self) -> int:
        return self.size

    def add(self, new: np.ndarray) -> None:
        if self.size + len(new) > len(self.held):
            room = np.empty(max(2 * len(self.held), self.size + len(new)), dtype=self.held.dtype)
            room[: self.size] = self.held[: self.size]
            self.held = room
        self.held[self.size : self.size + len(new)] = new
        self.size += len(new)

    def all(self) -> np.ndarray:
        return self.held[: self.size]


def _ranks(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... size - 1 for each size, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


class Pieces:
    """A vocabulary and the lattices of the words met so far."""

    def __init__(self, path: str, power: float = 1.0):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        weights: dict[str, tuple[int, float]] = {}
        self.bytes_of: list[bytes] = [b""] * self.size
        self.byte_ids = [0] * 256
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text = piece.replace("▁", " ")
                self.bytes_of[i] = text.encode()
                if " " not in text.lstrip(" ") and "\n" not in text:
                    weights[text] = (i, -power * math.log(2 + max(0.0, -sp.get_score(i))))
        self.byte_sizes = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.byte_starts = np.cumsum(self.byte_sizes) - self.byte_sizes
        self.byte_table = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.longest = max(map(len, weights))
        self._trie(weights)
        self.reset()

    def _trie(self, weights: dict[str, tuple[int, float]]) -> None:
        """Edges of a trie of the pieces as sorted numbers, node * characters + character; edge k
        leads to node k + 1."""
        chars = sorted(set("".join(weights)))
        self.char = np.zeros(0x110000, dtype=np.int32)  # 0: in no piece
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.chars = len(chars) + 1
        places: dict[str, int] = {"": 0}
        pieces = sorted(weights)
        edges: list[int] = []
        of_edge: list[str] = []
        for n in range(1, self.longest + 1):  # nodes of one depth after another, so that edges come out sorted
            level = sorted({w[:n] for w in pieces if len(w) >= n}, key=lambda w: (places[w[:-1]], int(self.char[ord(w[-1])])))
            for w in level:
                edges.append(places[w[:-1]] * self.chars + int(self.char[ord(w[-1])]))
                of_edge.append(w)
                places[w] = len(of_edge)
        self.edges = np.array(edges, dtype=np.int64)
        self.edge_piece = np.array([weights[w][0] if w in weights else -1 for w in of_edge], dtype=np.int32)
        self.edge_weight = np.array([weights[w][1] if w in weights else 0.0 for w in of_edge])
        self.alone = np.zeros(self.chars, dtype=bool)  # characters that are pieces themselves
        self.alone[[int(self.char[ord(c)]) for c in chars if c in weights]] = True

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.multi: list[list[int]] = []  # arcs of several ids; their codes come after the pieces
        self.multi_codes: dict[int, int] = {}
        self.ends = _Growing(np.int64)  # last node of each word
        self.first = _Growing(np.int64)  # first arc of each node
        self.arcs = _Growing(_ARC)

    def _fallback(self, char: int) -> int:
        """The code of a character's byte pieces."""
        if char not in self.multi_codes:
            self.multi_codes[char] = self.size + len(self.multi)
            self.multi.append([self.byte_ids[b] for b in chr(char).encode("utf-8", "surrogatepass")])
        return self.multi_codes[char]

    def _arcs(self, text: np.ndarray, until: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(starts, codes, weights) of the arcs of each length from 1 on; until: where words end."""
        char = self.char[text]
        at, node, found = np.arange(len(text)), np.zeros(len(text), dtype=np.int64), []
        for n in range(self.longest):
            key = node * self.chars + char[at + n]
            k = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            ok = self.edges[k] == key
            at, k = at[ok], k[ok]
            is_piece = self.edge_piece[k] >= 0
            starts, codes, weights = at[is_piece], self.edge_piece[k[is_piece]], self.edge_weight[k[is_piece]]
            if not n:
                odd = np.flatnonzero(~self.alone[char])
                kinds, which = np.unique(text[odd], return_inverse=True)
                own = np.array([self._fallback(int(c)) for c in kinds], dtype=np.int32)
                starts, codes, weights = np.concatenate([starts, odd]), np.concatenate([codes, own[which]]), np.concatenate([weights, np.full(len(odd), -20.0)])
            found.append((starts, codes, weights))
            on = at + n + 1 < until[at]
            at, node = at[on], (k[on] + 1).astype(np.int64)
        return found

    def learn(self, words: list[str]) -> None:
        """Lattices of all words at once. A node stands for what ends at its character; its arcs
        are in order of their starts, and are summed in that order, whatever words come along."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        end = np.cumsum(size)
        place = np.arange(len(text)) - np.repeat(end - size, size)
        found = self._arcs(text, np.repeat(end, size))
        count = np.zeros(len(text), dtype=np.int64)
        for n, (starts, _, _) in enumerate(found):
            count[starts + n] += 1  # a node has one arc of each length at most
        first = np.cumsum(count) - count
        start, code, weight = np.empty(count.sum(), np.int64), np.empty(count.sum(), np.int32), np.empty(count.sum())
        free = first.copy()
        for n in range(len(found) - 1, -1, -1):
            starts, codes, weights = found[n]
            k = free[starts + n]
            start[k], code[k], weight[k] = starts, codes, weights
            free[starts + n] += 1
        before = np.where(place[start] > 0, start - 1, len(text))
        alpha = np.zeros(len(text) + 1)  # the last stands for the words' starts
        chance = np.empty(len(start))
        order = np.argsort(place.astype(np.uint16) if len(text) and place.max() < 1 << 16 else place, kind="stable")
        cuts = np.flatnonzero(np.diff(place[order], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):  # nodes of one place in all words
            nodes = order[a:b]
            n = count[nodes]
            seg = np.cumsum(n) - n
            arcs = np.repeat(first[nodes] - seg, n) + np.arange(n.sum())
            v = weight[arcs] + alpha[before[arcs]]
            top = np.maximum.reduceat(v, seg)
            v = np.exp(v - np.repeat(top, n))
            total = np.add.reduceat(v, seg)
            alpha[nodes] = top + np.log(total)
            chance[arcs] = v / np.repeat(total, n)
        rank = np.arange(len(start)) - np.repeat(first, count)
        for r in range(1, int(count.max(initial=0))):
            k = np.flatnonzero(rank == r)
            chance[k] += chance[k - 1]
        arcs = np.empty(len(start), dtype=_ARC)
        arcs["last"] = np.maximum(np.minimum(chance * (1 << 32), (1 << 32) - 1).astype(np.int64), 1) - 1
        arcs["last"][first + count - 1] = (1 << 32) - 1
        nodes = len(self.first)
        arcs["back"] = np.where(place[start] > 0, start - 1 + nodes, -1)
        arcs["code"] = code
        self.index.update(zip(words, range(len(self.ends), len(self.ends) + len(words)), strict=True))
        self.ends.add(nodes + end - 1)
        self.first.add(first + len(self.arcs))
        self.arcs.add(arcs)

    def sample(self, texts: list[str], row_keys: list[int], seed: int) -> tuple[np.ndarray, np.ndarray]:
        """One segmentation of each text: all ids, one text after another, and where each begins
        (and the last ends)."""
        words = [_WORD.findall(" " + t) if t else [] for t in texts]
        new = set().union(*words) - self.index.keys()
        if new and len(self.first) > KEPT:
            self.reset()
            new = set().union(*words)
        if new:
            self.learn(sorted(new))
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        which = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=int(sizes.sum()))
        first = np.concatenate([[0], np.cumsum(sizes)])
        place = np.arange(len(which)) - np.repeat(first[:-1], sizes)
        doc = mixed(np.array([k & ((1 << 64) - 1) for k in row_keys], dtype=np.uint64) ^ np.uint64(seed & ((1 << 64) - 1)))
        state = mixed(np.repeat(doc, sizes) ^ place.astype(np.uint64))
        node, live, steps = self.ends.all()[which], np.arange(len(which)), []
        count = np.zeros(len(which), dtype=np.int64)
        first_arc, arcs = self.first.all(), self.arcs.all()
        while len(live):
            state = mixed(state)
            draw = (state >> np.uint64(32)).astype(np.uint32)
            arc = first_arc[node]
            chosen = arcs[arc]
            over = np.flatnonzero(draw > chosen["last"])
            while len(over):  # the draw is beyond the arc: on to the node's next one
                arc[over] += 1
                then = arcs[arc[over]]
                chosen[over] = then
                over = over[draw[over] > then["last"]]
            steps.append((live, chosen["code"].copy()))
            count[live] += 1
            node = chosen["back"].astype(np.int64)
            on = node >= 0
            node, live, state = node[on], live[on], state[on]
        ends = np.cumsum(count)
        out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
        for k, (at, codes) in enumerate(steps):
            out[ends[at] - 1 - k] = codes
        return self._plain(out, np.concatenate([[0], ends])[first])

    def _plain(self, codes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """codes with those of several ids replaced by these, and the cuts there."""
        odd = np.flatnonzero(codes >= self.size)
        if not len(odd):
            return codes, cuts
        several = [self.multi[c - self.size] for c in codes[odd].tolist()]
        size = np.ones(len(codes), dtype=np.int64)
        size[odd] = [len(m) for m in several]
        ends = np.concatenate([[0], np.cumsum(size)])
        out = np.repeat(codes, size)
        at = ends[odd]
        out[np.repeat(at, size[odd]) + _ranks(size[odd])] = list(chain.from_iterable(several))
        return out, ends[cuts]

    def lossless(self, ids: np.ndarray, cuts: np.ndarray, texts: list[str]) -> list[bool]:
        """Whether each text's ids decode to it."""
        n = self.byte_sizes[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        back = self.byte_table[np.repeat(self.byte_starts[ids], n) + _ranks(n)]
        want = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        at = ends[cuts]
        whole = np.frombuffer(b"".join(want), dtype=np.uint8)
        if np.array_equal(at, np.cumsum([0, *map(len, want)])) and np.array_equal(whole, back):
            return [True] * len(texts)
        return [back[a:b].tobytes() == w for a, b, w in zip(at[:-1].tolist(), at[1:].tolist(), want, strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text of any sequence of ids that sample() gives, without the space it puts in front."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")[1:]


@lru_cache(maxsize=2)
def vocabulary_of(path: str, power: float) -> Pieces:
    """A worker's vocabulary, with the lattices that its tasks have met: ids don't depend on them."""
    return Pieces(path, power)


def encode(docs: DataFrame, path: str, text: str = "text", seed: int = 8, power: float = 1.0) -> DataFrame:
    """(doc_id, n_pieces, ids, lossless) for every row of docs; lossless: the ids decode to the text.

    Null and empty texts have no ids. Repeated rows get equal results, as the row's id seeds them
    (null ids share a seed); an empty table gives no rows; other columns are not looked at. A text
    without spaces or line breaks has one lattice, whose memory grows with its length; it isn't
    kept for longer than the batch."""

    def parts(sizes: list[int]) -> Iterator[tuple[int, int]]:
        """Runs of at most ROWS rows, and of CHARS characters unless a row alone has more."""
        first = held = 0
        for i, n in enumerate(sizes):
            if i > first and (i - first >= ROWS or held + n > CHARS):
                yield first, i
                first, held = i, 0
            held += n
        if first < len(sizes):
            yield first, len(sizes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(path, power)
        for whole in batches:
            keys, bodies = whole.column(0).to_pylist(), [t or "" for t in whole.column(1).to_pylist()]
            for a, b in parts([len(t) for t in bodies]):
                ids, cuts = vocabulary.sample(bodies[a:b], [k or 0 for k in keys[a:b]], seed)
                same = vocabulary.lossless(ids, cuts, bodies[a:b])
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(a, b - a), pa.array(np.diff(cuts)), lists, pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids", "lossless"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_pieces long, ids array<int>, lossless boolean")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(path, 1.0)
        for b in batches:
            texts = [None if i is None else vocabulary.decode(i) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(work, "doc_id long, text string")
