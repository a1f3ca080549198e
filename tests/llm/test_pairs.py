"""Embeddings (op1), SimHash (op6) and their components against brute force."""

import numpy as np
import pytest
import xxhash

from tessera.llm import hnsw, simhash
from tessera.llm.common import components

V = "vec_id long, embedding array<float>, label int, node string, k int"


def closure(ids, linked):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


@pytest.mark.parametrize("size", [4096, 5])
def test_embeddings(spark, size):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = []
    for i in range(240):
        v = centres[i % 12] + rng.normal(size=8) * 0.12
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 2, "x", 1))
    rows += [(500 + i, rows[0][1], rows[0][2], "x", 1) for i in range(30)]  # a group of copies
    odd = [(900, None, 0, "x", 1), (901, [0.0] * 8, 0, "x", 1), (902, [float("nan")] * 8, 0, "x", 1), (903, [None] + [1.0] * 7, 0, "x", 1)]
    odd += [(904, rows[0][1], None, "x", 1), (905, [float("inf")] + [1.0] * 7, 0, "x", 1), (906, [], 0, "x", 1), (907, [1.0], 0, "x", 1)]
    got = {r.vec_id: r for r in hnsw.near_duplicates(spark.createDataFrame(rows + odd, V), 0.98, size).collect()}
    x = np.array([r[1] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & np.equal.outer([r[2] for r in rows], [r[2] for r in rows])
    linked = [(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(np.triu(near, 1)))]
    low = closure([r[0] for r in rows], linked)
    assert len(got) == len(rows) + len(odd)
    for i, r in enumerate(rows):
        assert (got[r[0]].n_links, got[r[0]].component_id, got[r[0]].kept) == (near[i].sum() - 1, low[r[0]], low[r[0]] == r[0])
    assert all((got[r[0]].n_links, got[r[0]].component_id, got[r[0]].kept) == (0, r[0], True) for r in odd)
    assert all(r.audit_recall >= 0.999 for r in got.values())
    assert hnsw.near_duplicates(spark.createDataFrame([], V)).count() == 0


def test_graph_search_and_audit_on_sparse_links():
    """Random vectors: hardly any link among them, so the audit's turned copies have to show the recall."""
    rng = np.random.default_rng(4)
    x, q = (hnsw.unit(rng.normal(size=(n, 24))) for n in (1500, 400))
    q[:60] = hnsw.unit(x[:60] + rng.normal(size=(60, 24)) * 0.02)
    graph = hnsw.Graph.build(x.astype(np.float32))
    i, j, seen, asked = hnsw.linked(graph, x, q, 0.98, False)
    want = set(zip(*np.nonzero(q @ x.T >= 0.98), strict=True))
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(want) >= 60
    assert asked >= hnsw.AUDIT and seen >= 0.999 * asked
    broken = hnsw.Graph(graph.x, [np.full_like(k, -1) for k in graph.layers], graph.entry)  # nothing can be reached
    i, j, seen, asked = hnsw.linked(broken, x, q, 0.98, False)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and seen == asked  # widened to a scan


def brute_fingerprint(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rng = np.random.default_rng(5)
    words = ["alpha", "Beta", "gamma", "délta", "EPSİ", "zeta", "eta x", "theta"]
    texts = [None, "", " \t\n", "one", "one two", "one two three", "ONE two\tthree", "é" * 50_000 + " b c d"]
    for _ in range(60):
        t = [words[k] for k in rng.integers(0, 8, 60)]
        texts += [" ".join(t), " ".join(t[:-1] + ["other"]), "  ".join(t)]
    rows = [(i * 7 % 1009, t, "d") for i, t in enumerate(texts)] + [(3, texts[-1], "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    fps = {(i, t): brute_fingerprint(t) for i, t, _ in rows}
    keys = list(fps)
    linked = [(a[0], b[0]) for n, a in enumerate(keys) for b in keys[n + 1 :] if bin(fps[a] ^ fps[b]).count("1") <= 2]
    low = closure({k[0] for k in keys}, linked)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    want = {i: set() for i, _, _ in rows}
    for (i, _), f in fps.items():
        want[i].add(f"{f:016x}")
    assert all(r.fingerprint in want[r.doc_id] for r in got)
    single = {i for i, w in want.items() if len(w) == 1}
    assert all(r.component_id == low[r.doc_id] for r in got if r.doc_id in single)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_links_between_near_fingerprints(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    all_fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(12):
            all_fps.add(b ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    dense = {int(base[0]) ^ k for k in range(3000)}  # one entry with thousands of fingerprints
    fps = sorted(all_fps | dense)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = {r.node: r.component for r in components(edges).collect()}
    arr = np.array(fps, dtype=np.uint64)
    pairs = []
    for n, f in enumerate(arr):
        hit = np.flatnonzero(np.bitwise_count(arr[n + 1 :] ^ f) <= 2) + n + 1
        pairs += [(signed[n], signed[k]) for k in hit]
    low = closure(signed, pairs)
    assert {s: got.get(s, s) for s in signed} == low


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (7, 9), (9, 7), (8, 9), (None, 3), (300, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, 300: 100, 8: 7, 9: 7}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
