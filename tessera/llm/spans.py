"""Substring dedup by sliding sentence spans.

A text is cut into sentences: after a line break, after closing punctuation and a space, and
before a capital letter after a space (a passage may have been put into the middle of another
sentence). A sentence of more than MIN_WORDS words is taken clause by clause: it is cut after its
commas, colons and semicolons too. A span is a run of consecutive sentences, MIN_SENTENCES or more
of them with MIN_WORDS words or more. Spans are hashed and joined over all documents; a sentence that
a non-first occurrence of a repeated span covers is removed. The first occurrence is the one in the
document with the smallest id, and there the first.

Only some spans need to be hashed: from each sentence on the shortest, and up to each sentence the
shortest. If a span repeats, so does each shorter one within it, and these cover it: its first and
last sentence begin and end one; a sentence s between them begins one if there are MIN_WORDS from s
to the span's end, else ends one if there are as many from the span's beginning to s, else is too
close to both ends for the shortest span from the first sentence on not to reach it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, small_batches

MIN_SENTENCES, MIN_WORDS = 2, 20
_CUT = re.compile(r"\n\s*|(?<=[.!?…。！？])\s+|\s+(?=[A-ZÀ-ÖØ-Þ¿¡])")
_CLAUSE = re.compile(r"(?<=[,;:，；：])\s+")
#: Odd factors of the two hashes of a run: sums of its sentences' digests times powers.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Characters handled at once; a longer text is handled by itself.
CHARS = 1 << 20


def sentences(text: str, words_least: int = MIN_WORDS) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of each sentence; they cover the text from its first word on.
    Digests ignore case and the amount of white space."""
    import xxhash

    out, at = [], 0
    digest = xxhash.xxh3_128_digest
    for end in [*(m.end() for m in _CUT.finditer(text)), len(text)]:
        words = text[at:end].lower().split()
        if len(words) > words_least and len(clauses := [*(m.end() for m in _CLAUSE.finditer(text, at, end)), end]) > 1:
            for stop in clauses:
                if words := text[at:stop].lower().split():
                    out.append((at, stop, len(words), digest(" ".join(words).encode("utf-8", "surrogatepass"))))
                    at = stop
        elif words:
            out.append((at, end, len(words), digest(" ".join(words).encode("utf-8", "surrogatepass"))))
            at = end
    return out


def _powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n, modulo 2 ** 64."""
    factors = np.full(n + 1, base, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


def spans(texts: list[str], sentences_least: int = MIN_SENTENCES, words_least: int = MIN_WORDS) -> tuple[np.ndarray, ...]:
    """(text, h1, h2, start, end, again) of the spans of all texts, as arrays, in order: the text's
    place, two hashes, character offsets, and whether the text has had the same span before."""
    found = [sentences(t, words_least) for t in texts]
    size = np.array([len(f) for f in found], dtype=np.int64)
    n = int(size.sum())
    if not n:
        none = np.array([], dtype=np.int64)
        return none, none, none, none, none, none.astype(bool)
    starts, ends, words = (np.fromiter((s[c] for f in found for s in f), dtype=np.int64, count=n) for c in range(3))
    digests = np.frombuffer(b"".join(s[3] for f in found for s in f), dtype=np.uint64).reshape(n, 2)
    owner = np.repeat(np.arange(len(texts)), size)
    last = np.cumsum(size)
    lo, hi = (last - size)[owner], last[owner]
    total, here = np.concatenate([[0], np.cumsum(words)]), np.arange(n)
    to = np.maximum(np.searchsorted(total, total[:n] + words_least, side="left"), here + sentences_least)
    since = np.minimum(np.searchsorted(total, total[1:] - words_least, side="right") - 1, here + 1 - sentences_least)
    on, up = to <= hi, since >= lo
    run = np.unique(np.concatenate([here[on] * (n + 1) + to[on], since[up] * (n + 1) + here[up] + 1]))
    i, j = run // (n + 1), run % (n + 1)
    hashes = []
    for k, base in enumerate(_BASES):
        # a run's powers go down to 1 at its last sentence, wherever it stands
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(digests[:, k] * _powers(base, n)[n - 1 :: -1], out=sums[1:])
        hashes.append((sums[j] - sums[i]) * _powers(pow(base, -1, 1 << 64), n)[n - j])
    order = np.lexsort((i, hashes[1], hashes[0], owner[i]))
    same = (owner[i][order][1:] == owner[i][order][:-1]) & np.logical_and(*(h[order][1:] == h[order][:-1] for h in hashes))
    again = np.zeros(len(i), dtype=bool)
    again[order[1:]] = same
    return owner[i], hashes[0].view(np.int64), (hashes[1] >> np.uint64(32)).astype(np.uint32).view(np.int32), starts[i], ends[j - 1], again


def _kid(text: Column) -> Column:
    """The documents' order: rows under one id are one document, null ids come after all others,
    told apart by their texts."""
    return F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64(text), 2) + F.lit(1 << 62))


def _key(text: Column) -> Column:
    return (F.crc32(F.coalesce(text, F.lit("")).cast("binary")) - (1 << 31)).cast("int")


def _listed(docs: DataFrame, text: str, sentences_least: int, words_least: int) -> DataFrame:
    """(h1, h2, kid, crc, at, again) a row for each span and document. The hashes of repeats within
    a document are mixed with their place, so that they meet nothing."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = [t or "" for t in b.column(1).to_pylist()]
            kids = b.column(0).to_numpy()
            first = 0
            while first < len(bodies):
                stop, held = first + 1, len(bodies[first])
                while stop < len(bodies) and held + len(bodies[stop]) <= CHARS:
                    held += len(bodies[stop])
                    stop += 1
                part = bodies[first:stop]
                which, h1, h2, start, end, again = spans(part, sentences_least, words_least)
                crcs = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) - (1 << 31) for t in part], dtype=np.int32)
                at = start << 32 | end
                own = kids[first:stop][which]
                h1 = np.where(again, h1 ^ (at * 31 + own), h1)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h1, h2, own, crcs[which], at, again)], names=["h1", "h2", "kid", "crc", "at", "again"])
                first = stop

    body = F.col(text).cast("string")
    return docs.select(_kid(body).alias("kid"), body.alias("text")).mapInArrow(work, "h1 long, h2 int, kid long, crc int, at long, again boolean")


def remove_repeats(docs: DataFrame, text: str = "text", sentences_least: int = MIN_SENTENCES, words_least: int = MIN_WORDS) -> DataFrame:
    """docs with the repeated sentences cut out of `text`, and n_removed (characters) appended.

    Null and empty texts stay as they are; a text may become empty. Rows under one id are one
    document: they don't remove sentences of each other. Rows of a null id come after all others, and
    each text of theirs is a document; rows alike in id and text lose the same sentences. An empty
    table gives no rows; all other columns are kept, whatever their names (an existing n_removed is
    replaced)."""
    small_batches(docs.sparkSession)
    listed = _listed(docs, text, sentences_least, words_least)
    # a document has each span once here, so that a hash of several rows is one of several documents
    many = listed.where("not again").groupBy("h1", "h2").agg(F.min("kid").alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    later = listed.join(many, ["h1", "h2"], "left").where("again or kid > first")
    cuts = later.groupBy("kid", "crc").agg(F.collect_list("at").alias("cuts"))
    docs = docs.drop("n_removed")
    names = list(docs.columns)
    kid, crc, cut = (fresh(names, n) for n in ("kid", "crc", "cuts"))
    body = F.col(f"`{text}`").cast("string")
    rows = docs.withColumns({kid: _kid(body), crc: _key(body)}).join(cuts.toDF(kid, crc, cut), [kid, crc], "left").select(*[F.col(f"`{c}`") for c in names], cut)
    place = names.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies, gone = [], []
            for body, cut in zip(b.column(place).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                kept = without(body, [(c >> 32, c & 0xFFFFFFFF) for c in cut]) if cut and body else body
                gone.append(len(body or "") - len(kept or ""))
                bodies.append(kept)
            cols = [b.column(i) for i in range(len(names))]
            cols[place] = pa.array(bodies, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(gone, pa.int64())], names=[*names, "n_removed"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + ", n_removed long"
    return rows.mapInArrow(work, schema)


def without(text: str, cuts: list[tuple[int, int]]) -> str:
    """text without the characters in any of the ranges [start, end)."""
    out, at = [], 0
    for start, end in sorted(cuts):
        if start > at:
            out.append(text[at:start])
        at = max(at, end)
    return "".join([*out, text[at:]])
