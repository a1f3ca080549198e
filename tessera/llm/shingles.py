"""Near copies by word shingles: op6's index finds candidates, Jaccard similarity decides.

Two texts are near copies if the sets of their shingles (runs of WORDS words, as op6 cuts words)
have a Jaccard similarity of at least LEAST. At 0.8 some 10 of 64 bits of a SimHash differ, so each
different text has several independent ones, of its set of shingles, and those meet that share bytes
of any (`simhash.meetings`, with the chance to miss a pair). That chance is larger for sets of four or
five shingles, so those of up to nine meet exactly: at 0.8 they are equal or differ in one shingle that
only one has. A bucket's pivot is its text that meets most others; every text is compared with the
greatest of its buckets' pivots, which settles most buckets. What the others' pivots tie together is a
neighbourhood: a text is in some dozens of buckets, but in one neighbourhood, whose texts of different
components are compared within tasks, block by block: links come out of it, never pairs. Every pair
that shares a bucket is either connected or has been compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import components, small_batches, stash

WORDS, LEAST = 5, 0.8
#: Texts of a block of a neighbourhood, and its most blocks, so that a text is dealt MOST times at most;
#: a block of more bytes of shingles than BLOCK is cut further, as a task holds two of them.
TEXTS, MOST = 64, 32
BLOCK = 8 << 20
#: Shingles of a set up to which it is met without fingerprints too.
FEW = 9
_SPACE, _UPPER = "[ \\t\\n\\x0B\\f\\r]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The different shingles of one text, hashed and sorted; fewer words are one shingle, and
    null, empty and blank texts have the shingle of the empty text."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    flat, n = b" ".join(found), len(found)
    if n <= words:
        return np.array([xxhash.xxh64_intdigest(flat, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, view = xxhash.xxh64_intdigest, memoryview(flat)
    spans = zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(view[a:b], 42) for a, b in spans), dtype=np.uint64, count=n - words + 1))


def few(found: np.ndarray, least: float = LEAST) -> np.ndarray:
    """Keys of a small set: of itself, and of itself without each of its shingles, where a set that
    lacks one is similar enough (else all sets of a single shingle would meet, without any)."""
    if len(found) > FEW:
        return found[:0]
    whole = found.sum(dtype=np.uint64)
    return np.concatenate([[whole], whole - found if len(found) - 1 >= least * len(found) - 1e-9 else found[:0]])


def node(text: str = "text") -> Column:
    """The number of a text: texts of the same words, case apart, have the same."""
    plain = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), _UPPER, _UPPER.lower())
    return F.xxhash64(F.trim(F.regexp_replace(plain, _SPACE, " ")))


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of rows (node, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                found = [shingles(t, words).view(np.int64) for t in b.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], names=["node", "shingles"])

    return rows.mapInArrow(work, "node long, shingles array<long>")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with their similarity, like: row by row, so that long sets need no more memory
    than a pair of them."""
    full = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return full.select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("like"))


def _linked(a: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes of different roots with a similarity of at least least, as far as they connect
    what isn't connected yet. The most common root's own nodes are not compared with one another.

    With the rarest shingles first, similar sets have one in common among their first ones, of which
    there are one more than either may have without the other; only sets that do are compared."""
    nodes, roots = a["node"].to_numpy(), np.unique(a["root"].to_numpy(), return_inverse=True)[1]
    held = a["shingles"].combine_chunks()
    size = np.diff(held.offsets.to_numpy())
    _, code, seen = np.unique(held.flatten().to_numpy(), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(size)), size)
    rank = np.empty(len(seen), dtype=np.int64)
    rank[np.argsort(seen, kind="stable")] = np.arange(len(seen))
    code = rank[code]
    code = code[np.lexsort((code, owner))]
    ends = np.cumsum(size)
    needed = size - np.ceil(least * size - 1e-9).astype(np.int64) + 1
    early = np.arange(len(code)) - np.repeat(ends - size, size) < np.repeat(needed, size)
    every, begun = _owners(code, owner, len(seen)), _owners(code[early], owner[early], len(seen))
    common, left, right = int(np.argmax(np.bincount(roots))), [], []
    for i in np.flatnonzero(roots != common):
        mine = code[ends[i] - size[i] : ends[i]]
        if (roots[_having(begun, mine[: needed[i]])] == roots[i]).all():
            continue
        both = np.bincount(_having(every, mine), minlength=len(size))
        hit = np.flatnonzero((both >= least * (size + size[i] - both) - 1e-9) & (roots != roots[i]))
        for other in np.unique(roots[hit]):
            left.append(nodes[i])
            right.append(nodes[hit[np.argmax(roots[hit] == other)]])
            roots[roots == other] = roots[i]
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def _owners(code: np.ndarray, owner: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray]:
    """Owners of each code, one code after another, and where each code's begin."""
    return owner[np.argsort(code, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(code, minlength=codes))])


def _having(owners: tuple[np.ndarray, np.ndarray], codes: np.ndarray) -> np.ndarray:
    """The owners of any of codes, once for each of them."""
    found, first = owners
    n = first[codes + 1] - first[codes]
    return found[np.repeat(first[codes] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def _dealt(rest: DataFrame) -> DataFrame:
    """Texts (node, root, hood, shingles) as tasks get them, (hood, x, y, node, root, shingles).

    Each two blocks of a neighbourhood, cut by hash, are a task's work (x, y), so a text comes as often
    as there are blocks. Those are MOST at most, however many texts there are, unless its shingles are
    of more than MOST times BLOCK bytes."""
    cut = F.greatest(F.least(F.ceil(F.count("*") / TEXTS), F.lit(MOST)), F.ceil(F.sum(8 * F.size("shingles") + 64) / BLOCK))
    blocks = stash(rest.groupBy("hood").agg(cut.cast("int").alias("blocks")).where("blocks > 1"), "blocks")
    dealt = rest.join(blocks, "hood", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("hood", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node", "root", "shingles")


def _between(rest: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between the different roots of each neighbourhood of rest (node, root, hood,
    shingles), which is compared within tasks, so pairs are never rows."""

    def work(t: pa.Table) -> pa.Table:
        a, b = _linked(t, least)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _dealt(rest).groupBy("hood", "x", "y").applyInArrow(work, "a long, b long")


def _hoods(ties: DataFrame, comp: DataFrame) -> DataFrame:
    """(node, root, hood) of the nodes of neighbourhoods of several roots. Ties (node, pivot) are those
    of each bucket's texts to its pivot, so that a bucket's roots have one neighbourhood."""

    def rooted(rows: DataFrame, name: str, root: str) -> DataFrame:
        return rows.join(comp.toDF(name, "found"), name, "left").withColumn(root, F.coalesce("found", name)).drop("found")

    between = rooted(rooted(ties, "node", "a"), "pivot", "b").where("a <> b").select("a", "b").distinct()
    tied = components(between).toDF("root", "hood")
    hoods = tied.union(tied.select("hood", "hood").distinct())
    return rooted(ties.select("node").distinct(), "node", "root").join(hoods, "root").select("node", "root", "hood")


def near_copies(docs: DataFrame, text: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """(doc_id, node, component) for every row of docs: component is the same for rows that near
    copies connect.

    Null, empty and blank texts are copies of one another. Null ids and repeated rows are rows
    like any others; an empty table gives no rows; other columns of docs are not looked at."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), node(text).alias("node"), F.col(text).cast("string").alias("text"))

    names = [f"p{i}" for i in range(simhash.PRINTS)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                sets = [shingles(t, words) for t in b.column(2).to_pylist()]
                found = np.array([simhash.prints(s) for s in sets]).view(np.int64)
                small = [few(s, least).view(np.int64) for s in sets]
                ends = np.cumsum([0, *map(len, small)]).astype(np.int32)
                small = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(small)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), small, *(pa.array(p) for p in found.T)], names=["doc_id", "node", "few", *names])

    found = stash(rows.mapInArrow(work, f"doc_id long, node long, few array<long>, {', '.join(f'{n} long' for n in names)}"), "prints")
    # one row of each text stands for all; a null id comes after all others
    one = stash(found.groupBy("node").agg(*[F.min(n).alias(n) for n in names]), "texts")
    small = found.select(F.explode("few").alias("k"), "node")
    entries = stash(simhash.meetings(one).union(small).distinct(), "entries")
    buckets = entries.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    meeting = stash(entries.join(buckets, "k"), "meeting")
    meeting = meeting.join(meeting.groupBy("node").agg(F.sum("n").alias("meets")), "node")
    pivots = meeting.groupBy("k").agg(F.max(F.struct("meets", "node")).alias("pivot"))
    members = stash(meeting.select("k", "node").join(pivots, "k"), "members")
    best = members.groupBy("node").agg(F.max("pivot").alias("pivot")).select(F.col("node").alias("a"), F.col("pivot.node").alias("b")).where("a <> b")
    met = members.select("node").distinct()
    stands = found.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(met, "node")
    same = (F.col("r.node") == F.col("s.node")) & F.col("r.doc_id").eqNullSafe(F.col("s.doc_id"))
    texts = rows.alias("r").join(stands.alias("s"), same, "left_semi").select("node", "text")
    # rows may repeat an id and a text: their sets are equal
    sets = stash(_sets(texts, words).groupBy("node").agg(F.min("shingles").alias("shingles")), "sets")
    near = stash(_compared(best, sets).where(F.col("like") >= least - 1e-9).select("a", "b"), "near")
    comp = components(near)
    ties = members.select("node", F.col("pivot.node").alias("pivot")).distinct()
    rest = stash(_hoods(ties, comp).join(sets, "node").select("node", "root", "hood", "shingles"), "mixed")
    comp = components(near.union(_between(rest, least)))
    return found.select("doc_id", "node").join(comp, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("component"))
