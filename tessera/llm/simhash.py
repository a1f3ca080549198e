"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 2 bits share at least 6 of their 8 positional
bytes. The index therefore has, for each fingerprint, one entry for every set of six byte
positions with the bytes there (28 entries): two fingerprints meet in an entry if and only if
their tally of shared positional bytes reaches that minimum. Within an entry the tally of each pair
that may link is taken, whatever the entry's size; pairs below the minimum are left out, and the bit
distance of the others decides. As six bytes are fixed, an entry can hold 65,536 different
fingerprints at most, whatever the data: no group is unbounded, and none is capped.

Wider distances, as the pipeline's near copies need them, have the same index over several
fingerprints: `prints` and `meetings`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, stash

MIN_SHARED = 6
MASKS = [sum(0xFF << (8 * p) for p in ps) for ps in combinations(range(8), MIN_SHARED)]
_SIGNED = [m - (1 << 64) if m >> 63 else m for m in MASKS]
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_FLIPS = np.array([1 << i for i in range(64)], dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of one text; null, empty and blank texts have 0."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    n = len(words)
    if n <= 3:
        h = np.array([xxhash.xxh64_intdigest(flat, 42)], dtype=np.uint64)
    else:
        lens = np.fromiter(map(len, words), dtype=np.int64, count=n)
        starts = np.zeros(n, dtype=np.int64)
        np.cumsum(lens[:-1] + 1, out=starts[1:])
        ends = (starts + lens)[2:]
        digest, view = xxhash.xxh64_intdigest, memoryview(flat)
        h = np.array([digest(view[a:b], 42) for a, b in zip(starts[: n - 2].tolist(), ends.tolist())], dtype=np.uint64)
    parts = h.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(parts[:, k], minlength=256) @ _BITS for k in range(8)])
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(h)).tolist())


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. A row for each row of docs, null
    ids and repeated rows included."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(work, "doc_id long, fp long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (value, smallest value of its component) of the graph of the pairs a, b."""
    values, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = idx[: len(a)], idx[len(a) :]
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    own = label != np.arange(len(values))
    return values[own], values[label[own]]


#: Fingerprints of an entry up to which each is met with every other; in a longer one, each is met with
#: those that its flipped bits give. Both find every pair within `bits`; all found are then verified.
SHORT = 64


def _linked(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs reach the least number of shared positional bytes, and then differ little enough."""
    d = x ^ y
    shared = (d[:, None].view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    return (shared >= MIN_SHARED) & (np.bitwise_count(d) <= bits)


def _pairs(entry: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of fingerprints within runs of equal entries (entry is sorted)."""
    edge = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1], [True]]))
    start, size = edge[:-1], np.diff(edge)
    found_a, found_b = [], []
    short = (size > 1) & (size <= SHORT)
    if short.any():
        run = np.repeat(np.where(short, np.arange(len(size)), -1), size)
        for d in range(1, int(size[short].max())):
            k = np.flatnonzero((run[:-d] == run[d:]) & (run[d:] >= 0)) if d < len(run) else np.array([], dtype=int)
            k = k[_linked(fp[k], fp[k + d], bits)] if len(k) else k
            found_a.append(fp[k])
            found_b.append(fp[k + d])
    for s, n in zip(start[size > SHORT].tolist(), size[size > SHORT].tolist(), strict=True):
        v = np.unique(fp[s : s + n])
        free = np.bitwise_or.reduce(v) ^ np.bitwise_and.reduce(v)  # within 16 bits
        ones = _FLIPS[(_FLIPS & free) != 0]
        for flip in [*ones, *(p | q for p, q in combinations(ones, 2) if bits > 1)]:
            w = v ^ flip
            k = np.minimum(np.searchsorted(v, w), len(v) - 1)
            hit = (v[k] == w) & (v < w)
            hit[hit] = _linked(v[hit], w[hit], bits)
            found_a.append(v[hit])
            found_b.append(w[hit])
    none = np.array([], dtype=np.uint64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def links(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """Edges (a, b) among different fingerprints (column fp) which connect whatever is linked
    by `bits` (2 at most) or fewer differing bits: a spanning forest of each task's links."""
    if not 0 <= bits <= 2:
        raise ValueError("the index guarantees links of at most 2 bits")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.array([], dtype=np.uint64), np.array([], dtype=np.uint64)
        kinds = np.array([], dtype=np.int8)

        def edges(i, k, f):
            same = np.concatenate([[True], (k[1:] != k[:-1]) | (i[1:] != i[:-1])])
            a, b = _forest(*_pairs(np.cumsum(same), f, bits))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            kinds = np.concatenate([kinds, b.column(0).to_numpy()])
            held_k = np.concatenate([held_k, b.column(1).to_numpy().view(np.uint64)])
            held_f = np.concatenate([held_f, b.column(2).to_numpy().view(np.uint64)])
            ended = np.flatnonzero((held_k != held_k[-1]) | (kinds != kinds[-1]))
            n = int(ended[-1]) + 1 if len(ended) else 0
            if n:  # the last entry may go on in the next batch
                yield edges(kinds[:n], held_k[:n], held_f[:n])
                kinds, held_k, held_f = kinds[n:], held_k[n:], held_f[n:]
        if len(held_k) > 1:
            yield edges(kinds, held_k, held_f)

    entries = distinct.select("fp", F.posexplode(F.array(*[F.lit(m) for m in _SIGNED])).alias("i", "mask"))
    entries = entries.select(F.col("i").cast("byte").alias("i"), F.expr("fp & mask").alias("k"), "fp")
    return entries.repartition("i", "k").sortWithinPartitions("i", "k").mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Equal texts, null, empty and blank texts included (fingerprint zero), link like any others.
    A null doc_id gets the component of the ids it links with, or null; repeated rows get equal
    results; an empty table gives no rows; other columns of docs are not looked at."""
    fps = stash(fingerprints(docs, text), "fingerprints")
    distinct = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    comp = components(links(distinct.select("fp"), bits))
    nodes = distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lows = nodes.groupBy("component").agg(F.min("low").alias("component_id"))
    nodes = nodes.join(lows, "component").select("fp", "component_id")
    return fps.join(nodes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near copies of a Jaccard similarity of 0.8 differ in some 10 of 64 bits, which may touch every byte,
# so one fingerprint guarantees no shared byte. A text therefore has PRINTS independent ones, and the
# least number of shared bytes is asked of any of them.

#: Fingerprints of a text; shared positional bytes of one that let two texts meet; bits in which it and
#: the next may then differ. At similarity 0.8 a bit differs with a probability of 0.151 (the angle of
#: two sets, arccos 2J / (1 + J), by pi), and a fingerprint lets two texts meet with one of 0.65, so that
#: PRINTS of them miss a pair with one of 1e-9 (6e-8 for 12 shingles within 15, whose bits differ more
#: often), and less above; more bits would bring in many texts of lesser similarity.
PRINTS, SHARED, FAR = 20, 2, 24
#: Texts that are dealt at once, and those of one fingerprint and byte that a task has, on average.
DEAL, HELD = 8192, 1 << 16
#: Pairs of an entry are listed if it has no more fingerprints than this; a longer one is spread over.
LISTED = 256
_SEEDS = np.random.default_rng(6).integers(0, 1 << 63, PRINTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX, _MIX2, _LOWEST = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x0101010101010101)


def prints(found: np.ndarray) -> np.ndarray:
    """The PRINTS fingerprints of a set of hashed shingles: a bit is 1 if it is in over half of them."""
    counts = np.zeros((8, 8 * PRINTS), dtype=np.int64)
    for at in range(0, len(found), 240):  # eight counts a word, which 255 would fill
        x = found[at : at + 240, None] ^ _SEEDS
        x *= _MIX
        x ^= x >> np.uint64(32)
        x *= _MIX2
        x ^= x >> np.uint64(32)
        for bit in range(8):
            counts[bit] += (x & _LOWEST).sum(axis=0).view(np.uint8)
            x >>= np.uint64(1)
    return np.packbits(2 * counts > len(found), axis=0, bitorder="little")[0].view(np.uint64)


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The bits in which rows (fingerprint, next) differ."""
    d = np.bitwise_count(x[..., 0] ^ y[..., 0]).astype(np.int16)
    return d + np.bitwise_count(x[..., 1] ^ y[..., 1])


def _spread(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within one long entry that connect what its pairs of at most FAR bits connect."""
    left, front, a, b = np.arange(1, len(f)), np.array([0]), [], []
    while len(left):
        if not len(front):
            front, left = left[:1], left[1:]
        n = max(1, (1 << 20) // max(1, len(left)))
        now, front = front[:n], front[n:]
        near = _differ(f[now][:, None], f[left][None]) <= FAR
        hit = near.any(axis=0)
        a.append(now[near.argmax(axis=0)[hit]])
        b.append(left[hit])
        front, left = np.concatenate([front, left[hit]]), left[~hit]
    return np.concatenate(a), np.concatenate(b)


def _met(rows: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, node): the groups among rows (fingerprint, next, node) connected by pairs that share byte
    `at` and a later one, and differ in FAR bits at most."""
    low, high = np.array([], dtype=np.uint64), np.array([], dtype=np.uint64)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def settle():
        nonlocal low, high, held
        low, high = _forest(*(np.concatenate(x) for x in zip((low, high), *held, strict=True)))
        held = []

    byte = rows[:, :1].copy().view(np.uint8)
    for other in range(at + 1, 8):
        key = byte[:, at].astype(np.uint16) << np.uint16(8) | byte[:, other]
        r = rows[np.argsort(key, kind="stable")]
        key = np.sort(key)
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        start, size = edge[:-1], np.diff(edge)
        last = np.repeat(edge[1:], size)
        k, d = np.flatnonzero(np.repeat(size <= LISTED, size)), 1
        while len(k := k[k + d < last[k]]):
            near = k[_differ(r[k], r[k + d]) <= FAR]
            held.append((r[near, 2], r[near + d, 2]))
            d += 1
            if sum(len(a) for a, _ in held) > 1 << 20:
                settle()
        for s, n in zip(start[size > LISTED].tolist(), size[size > LISTED].tolist(), strict=True):
            a, b = _spread(r[s : s + n])
            held.append((r[s + a, 2], r[s + b, 2]))
        settle()
    tops, which = np.unique(high, return_inverse=True)
    node, which = np.concatenate([low, tops]), np.concatenate([which, np.arange(len(tops))])
    mixed = (node ^ _SEEDS[0]) * _MIX
    mixed = (mixed ^ mixed >> np.uint64(32)) * _MIX2
    total = np.zeros(len(tops), dtype=np.uint64)  # equal groups have equal buckets, wherever they are found
    np.add.at(total, which, mixed)
    return total[which], node


def meetings(rows: DataFrame) -> DataFrame:
    """(k, node): buckets of texts that may be near copies, of rows (node, and its PRINTS fingerprints),
    one for each node; a bucket may come up several times.

    Two texts are in one bucket if some fingerprint of theirs reaches the least number of shared
    positional bytes, SHARED, and it and the next differ in at most FAR bits; what such pairs connect
    within a byte's entries is a bucket. Each fingerprint is dealt once for each of its first seven bytes,
    and a task has the texts of one byte, or of some of its values; there it makes the entries of that
    byte with each later one. No entry is capped: the pairs of a long one are searched from its first
    text on, without being listed."""
    texts, parts = rows.count(), 1
    while parts < 256 and parts * HELD < texts:
        parts *= 2

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def dealt():
            t = np.concatenate(held)
            for w in range(PRINTS):
                own = np.ascontiguousarray(t[:, [1 + w, 1 + (w + 1) % PRINTS, 0]])
                byte = own[:, :1].copy().view(np.uint8)
                for at in range(7):
                    part = byte[:, at].astype(np.int64) * parts >> 8
                    sizes = np.bincount(part, minlength=parts)
                    ends = np.cumsum([0, *24 * sizes]).astype(np.int32)
                    data = own[np.argsort(part, kind="stable")]
                    rows = pa.Array.from_buffers(pa.binary(), parts, [None, pa.py_buffer(ends), pa.py_buffer(data)])
                    ids = pa.array((w * 8 + at) * 256 + np.arange(parts), pa.int32())
                    yield pa.RecordBatch.from_arrays([ids, rows], names=["part", "rows"])

        for b in batches:
            if b.num_rows:
                held.append(np.stack([c.to_numpy().view(np.uint64) for c in b.columns], axis=1))
                n += b.num_rows
            if n >= DEAL:
                yield from dealt()
                held, n = [], 0
        if n:
            yield from dealt()

    def work(t: pa.Table) -> pa.Table:
        found = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint64).reshape(-1, 3) for x in t["rows"]])
        k, node = _met(found, t["part"][0].as_py() // 256 % 8)
        return pa.table({"k": pa.array(k.view(np.int64)), "node": pa.array(node.view(np.int64))})

    return rows.mapInArrow(deal, "part int, rows binary").groupBy("part").applyInArrow(work, "k long, node long")
