"""Embedding near-duplicates: hierarchical navigable small-world graphs, one per shard.

Vectors of one label are spread over shards of a bounded size by hash. Each shard's graph is
built once (layers by geometric levels, links chosen for diversity) and written down. Shards of a label
make up tiles, every two tiles of a label are one task, and each shard there is searched for each other's
vectors, all queries in step; so a shard is sent once per tile, not once per shard. Before that, some of
the queries and some vectors near the shard's own are audited by brute force, and as long as the graph
misses one link in a thousand of theirs, beams are widened. A query whose beam is full of links gets a
wider one by itself, up to WIDEST, and then a scan of the shard; beams as wide as the shard are a scan too,
so widening ends in exact results. Links found are verified by cosine in double precision. A task hands on, per vector, how many vectors it links with and the
smallest member of its component there; these are united over all tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, stash
from tessera.llm.simhash import _forest

#: Vectors aimed at in a shard; links of a node above layer 0 (twice as many there).
SHARD, M, BUILD_BEAM, BEAM, AUDIT, RECALL = 4096, 12, 48, 24, 96, 0.999
CHUNK = 512
#: Beams up to this wide are tried; a query that needs more is compared with all of the shard.
WIDEST = 16 * BEAM
#: Shards of a tile at most, and bytes of its vectors: a task compares two tiles, shard by shard.
TILE, TILE_BYTES = 8, 32 << 20
#: Single precision's error, by which candidates may fall below the threshold before verification.
SLACK = 1e-5


def beams(x: np.ndarray, links: np.ndarray, q: np.ndarray, entries: np.ndarray, width: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities), each (queries, width) in no order, -1 and -inf where there are fewer:
    best-first search of one layer for all of q in step, from entries (queries, any; -1: none)."""
    n, rows = len(q), np.arange(len(q))
    ids = np.full((n, width), -1, dtype=np.int32)
    sims = np.full((n, width), -np.inf, dtype=np.float32)
    fresh = np.zeros((n, width), dtype=bool)
    seen = np.zeros((n, len(x) + 1), dtype=bool)
    seen[:, -1] = True

    def offer(r: np.ndarray, new: np.ndarray) -> None:
        new = np.sort(new, axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[seen[r[:, None], new]] = -1
        seen[r[:, None], new] = True
        s = np.einsum("rmd,rd->rm", x[new], q[r])
        s[new < 0] = -np.inf
        all_s = np.concatenate([sims[r], s], axis=1)
        top = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
        sims[r] = np.take_along_axis(all_s, top, 1)
        ids[r] = np.take_along_axis(np.concatenate([ids[r], new], axis=1), top, 1)
        fresh[r] = np.take_along_axis(np.concatenate([fresh[r], new >= 0], axis=1), top, 1)

    offer(rows, entries.astype(np.int32))
    while True:
        r = np.flatnonzero(fresh.any(axis=1))
        if not len(r):
            return ids, sims
        open_s = np.where(fresh[r], sims[r], -np.inf)
        k = min(at_once, width)
        best = np.argpartition(-open_s, k - 1, axis=1)[:, :k]
        chosen = np.where(np.take_along_axis(open_s, best, 1) > -np.inf, np.take_along_axis(ids[r], best, 1), -1)
        fresh[r[:, None], best] = False
        near = np.where(chosen[:, :, None] >= 0, links[chosen], -1)
        offer(r, near.reshape(len(r), -1))


def diverse(x: np.ndarray, of: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
    """(rows, most) of the candidates (-1: none): nearest first, each kept only if it is nearer
    to its node than to any kept one; room that is left goes to the nearest of the others."""
    s = np.einsum("rmd,rd->rm", x[cand], x[of])
    s[cand < 0] = -np.inf
    order = np.argsort(-s, axis=1, kind="stable")
    cand, s = np.take_along_axis(cand, order, 1), np.take_along_axis(s, order, 1)
    v = x[cand]
    between = v @ v.transpose(0, 2, 1)
    kept = np.zeros(cand.shape, dtype=bool)
    nearest = np.full(cand.shape, -np.inf, dtype=np.float32)  # to any kept one
    count = np.zeros(len(cand), dtype=int)
    for k in range(cand.shape[1]):
        ok = (cand[:, k] >= 0) & (s[:, k] > nearest[:, k]) & (count < most)
        kept[:, k] = ok
        count += ok
        nearest[ok] = np.maximum(nearest[ok], between[ok, k])
    rank = np.argsort(np.where(kept, 0, np.where(cand >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(cand, rank, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1) if out.shape[1] < most else out


class Graph:
    """The layers of one shard over unit vectors x (single precision)."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray], entry: int):
        self.x, self.layers, self.entry = x, layers, entry

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 1) -> Graph:
        n = len(x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(M)).astype(int), 6)
        order = np.argsort(-level, kind="stable")  # the top layers first, so every layer is entered
        layers = [np.full((n, M if k else 2 * M), -1, dtype=np.int32) for k in range(int(level.max(initial=0)) + 1)]
        g = cls(x, layers, int(order[0]) if n else -1)
        done = 1
        while done < n:
            g._insert(order[done : done + min(1024, max(32, done))], level)
            done += min(1024, max(32, done))
        return g

    def _insert(self, new: np.ndarray, level: np.ndarray) -> None:
        entries = np.full((len(new), 1), self.entry, dtype=np.int32)
        for k in range(len(self.layers) - 1, -1, -1):
            links, most = self.layers[k], self.layers[k].shape[1]
            here = np.flatnonzero(level[new] >= k)
            ids, sims = beams(self.x, links, self.x[new], entries, BUILD_BEAM if len(here) else 8)
            entries = np.take_along_axis(ids, np.argsort(-sims, axis=1)[:, :8], 1)
            if not len(here):
                continue
            own = new[here]
            among = self.x[own] @ self.x[own].T
            np.fill_diagonal(among, -np.inf)
            near = min(16, len(own) - 1)
            cand = ids[here]
            if near:
                cand = np.concatenate([cand, own[np.argpartition(-among, near - 1, axis=1)[:, :near]].astype(np.int32)], axis=1)
            links[own] = diverse(self.x, own, cand, most)
            a, b = np.repeat(own, most), links[own].ravel()
            self._back(links, b[b >= 0], a[b >= 0])

    def _back(self, links: np.ndarray, to: np.ndarray, new: np.ndarray, most_new: int = 24) -> None:
        """Links the other way, the nearest few where many come at once; full nodes choose again."""
        sims = np.einsum("nd,nd->n", self.x[to], self.x[new])
        order = np.lexsort((-sims, to))
        to, new = to[order], new[order]
        start = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        rank = np.arange(len(to)) - np.repeat(start, np.diff(np.append(start, len(to))))
        nodes, slot = to[start], np.searchsorted(to[start], to)
        extra = np.full((len(nodes), most_new), -1, dtype=np.int32)
        ok = rank < most_new
        extra[slot[ok], rank[ok]] = new[ok]
        extra[(extra[:, :, None] == links[nodes][:, None, :]).any(axis=2)] = -1
        links[nodes] = diverse(self.x, nodes, np.concatenate([links[nodes], extra], axis=1), links.shape[1])

    def search(self, q: np.ndarray, width: int, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Beams of the lowest layer; start: nodes to begin at besides those from above."""
        entries = np.full((len(q), 1), self.entry, dtype=np.int32)
        for k in range(len(self.layers) - 1, 0, -1):
            ids, sims = beams(self.x, self.layers[k], q, entries, 6)
            entries = np.take_along_axis(ids, np.argsort(-sims, axis=1)[:, :3], 1)
        if start is not None:
            entries = np.concatenate([entries, start[:, None].astype(np.int32)], axis=1)
        return beams(self.x, self.layers[0], q, entries, width)


def unit(v: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _found(graph: Graph, q: np.ndarray, width: int, low: np.float32, start: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries, nodes) that beams give from low on, and the queries whose beams were full of links
    up to the widest: those need a scan."""
    found, full = [np.zeros((2, 0), dtype=np.int64)], [np.array([], dtype=np.int64)]
    for a in range(0, len(q), CHUNK):
        rows, w = np.arange(a, min(a + CHUNK, len(q))), width
        while len(rows):
            ids, sims = graph.search(q[rows], w, None if start is None else start[rows])
            hit = sims >= low
            more = hit.all(axis=1)
            r, c = np.nonzero(hit & ~more[:, None])
            found.append(np.array([rows[r], ids[r, c]], dtype=np.int64))
            rows, w = rows[more], w * 4
            if w >= min(len(graph.x), WIDEST):
                full.append(rows)
                break
    i, j = np.concatenate(found, axis=1)
    return i, j, np.concatenate(full)


def probes(x: np.ndarray, q: np.ndarray, threshold: float, seed: int = 3) -> np.ndarray:
    """What an audit asks for: some of the queries, and as many of x's own vectors turned by half
    of the angle that links allow, so that there are links to find whatever the queries are."""
    some = q[np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int)]
    own = x[np.linspace(0, len(x) - 1, min(AUDIT, len(x))).astype(int)]
    away = np.random.default_rng(seed).normal(size=own.shape)
    away -= np.einsum("nd,nd->n", away, own)[:, None] * own
    size = np.linalg.norm(away, axis=1, keepdims=True)
    angle = np.arccos(min(1.0, max(-1.0, threshold))) / 2
    turned = own * np.cos(angle) + np.sin(angle) * away / np.where(size > 0, size, 1)
    return np.concatenate([some, turned]).astype(np.float32)


def linked(graph: Graph, x: np.ndarray, q: np.ndarray, threshold: float, own: bool) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Pairs (query, node) with cosine of at least threshold, and how many of the audit's links were
    found, of how many; x, q in double precision. own: q is x, and the pairs are each given once,
    without those of a vector with itself."""
    n, low = len(x), np.float32(threshold - SLACK)
    q32 = q.astype(np.float32)
    asked = probes(x, q, threshold)
    truth = (asked @ graph.x.T >= low).sum(axis=1)
    width, seen = min(BEAM, n), int(truth.sum())
    i = j = np.array([], dtype=np.int64)
    full = np.arange(len(q))
    while width < n:
        hits, _, scanned = _found(graph, asked, width, low, None)
        got = np.bincount(hits, minlength=len(asked))
        got[scanned] = truth[scanned]
        if got.sum() >= RECALL * truth.sum():
            seen = int(got.sum())
            i, j, full = _found(graph, q32, width, low, np.arange(n) if own else None)
            break
        width = min(n, width * 4)
    near = np.einsum("nd,nd->n", q[i], x[j]) >= threshold
    pairs = [(i[near], j[near])]
    for a in range(0, len(full), CHUNK):  # beams as wide as the shard
        r, c = np.nonzero(q[full[a : a + CHUNK]] @ x.T >= threshold)
        pairs.append((full[a + r], c))
    i, j = (np.concatenate([p[k] for p in pairs]).astype(np.int64) for k in (0, 1))
    if own:
        i, j = np.minimum(i, j), np.maximum(i, j)
        key = np.unique(i[i < j] * n + j[i < j])
        i, j = key // n, key % n
    return i, j, seen, int(truth.sum())


_SHARD = "label {}, dim int, shard int, shards int, ids binary, copies binary, vectors binary, links binary, layers int, entry int"


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, size: int = SHARD, embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall) for every row of vectors (vec_id, embedding,
    label). audit_recall: the share of all audits' links that the graphs gave, over all tasks.

    Vectors that are null, empty, zero or hold null or non-finite numbers, and those without a
    label or an id, link with nothing: n_links 0, their own component. So do vectors of different
    lengths. Copies of a vector are one node and link with one another; different vectors under
    one id are one node too. An empty table gives no rows; other columns are not looked at."""
    kind = dict(vectors.dtypes)["label"]
    v = F.transform(F.col(embedding).cast("array<double>"), lambda e: e + F.lit(0.0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"))
    good = F.coalesce(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0), F.lit(False))
    good = good & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.withColumn("k", F.when(good, F.xxhash64("label", "v")))
    nodes = rows.where("k is not null").groupBy("k", "label", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    nodes = stash(nodes.withColumn("dim", F.size("v")), "nodes")
    totals = nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / size).cast("int").alias("shards"))
    dealt = nodes.join(totals, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("k", F.lit(5)), F.col("shards")).cast("int"))

    def build(t: pa.Table) -> pa.Table:
        order = np.argsort(t["node"].to_numpy())
        t = t.take(pa.array(order))
        dim = t["dim"][0].as_py()
        x = t["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        g = Graph.build(unit(x).astype(np.float32))
        first = t.slice(0, 1).select(["label", "dim", "shard", "shards"])
        cells = [t["node"].to_numpy().astype(np.int64).tobytes(), t["copies"].to_numpy().astype(np.int64).tobytes(), x.tobytes(), b"".join(k.tobytes() for k in g.layers)]
        for name, cell in zip(("ids", "copies", "vectors", "links"), cells, strict=True):
            first = first.append_column(name, pa.array([cell], pa.binary()))
        return first.append_column("layers", pa.array([len(g.layers)], pa.int32())).append_column("entry", pa.array([g.entry], pa.int32()))

    shards = dealt.select("label", "dim", "shard", "shards", "node", "copies", "v").groupBy("label", "dim", "shard").applyInArrow(build, _SHARD.format(kind))
    shards = stash(shards, "shards")
    in_tile = F.greatest(F.lit(1), F.least(F.lit(TILE), F.ceil(F.col("shards") / 16), F.floor(TILE_BYTES / (8 * size * F.col("dim"))))).cast("int")
    dealt = shards.withColumn("in_tile", in_tile).withColumn("tile", F.floor(F.col("shard") / F.col("in_tile")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.floor((F.col("shards") - 1) / F.col("in_tile")).cast("int"))))
    pairs = other.withColumns({"a": F.least("tile", "other"), "b": F.greatest("tile", "other")})

    def opened(r: dict) -> tuple:
        """(ids, copies, unit vectors, graph) of a shard."""
        ids, copies = (np.frombuffer(r[c], dtype=np.int64) for c in ("ids", "copies"))
        x = unit(np.frombuffer(r["vectors"]).reshape(-1, r["dim"]))
        flat, n, layers, at = np.frombuffer(r["links"], dtype=np.int32), len(ids), [], 0
        for k in range(r["layers"]):
            width = M if k else 2 * M
            layers.append(flat[at : at + n * width].reshape(n, width))
            at += n * width
        return ids, copies, x, Graph(x.astype(np.float32), layers, r["entry"])

    def link(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["shard"])
        held = [opened(r) for r in rows]
        one = rows[0]["a"] == rows[0]["b"]
        parts, asked, seen = [], 0, 0
        for u in range(len(rows)):
            for v in range(u, len(rows)):
                if not one and (rows[u]["tile"] == rows[v]["tile"]):
                    continue  # another task's
                (ids, copies, x, graph), (q_ids, q_copies, q, _) = held[u], held[v]
                i, j, found, there = linked(graph, x, q, threshold, u == v)
                parts.append((q_ids[i], ids[j], q_copies[i], copies[j]))
                seen, asked = seen + found, asked + there
        told = pa.table({"node": pa.array([None], pa.int64()), "n": pa.array([seen], pa.int64()), "root": pa.array([asked], pa.int64())})
        a, b, a_copies, b_copies = (np.concatenate([np.array([], dtype=np.int64), *(p[k] for p in parts)]) for k in range(4))
        nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
        if not len(nodes):
            return told
        count = np.zeros(len(nodes), dtype=np.int64)
        np.add.at(count, inverse, np.concatenate([b_copies, a_copies]))
        root = nodes.copy()
        child, low = _forest(a.view(np.uint64) ^ np.uint64(1 << 63), b.view(np.uint64) ^ np.uint64(1 << 63))
        root[np.searchsorted(nodes, (child ^ np.uint64(1 << 63)).view(np.int64))] = (low ^ np.uint64(1 << 63)).view(np.int64)
        return pa.concat_tables([pa.table({"node": nodes, "n": count, "root": root}), told])

    pairs = pairs.select("label", "dim", "a", "b", "tile", "shard", "ids", "copies", "vectors", "links", "layers", "entry")
    made = stash(pairs.groupBy("label", "dim", "a", "b").applyInArrow(link, "node long, n long, root long"), "links")
    links = made.where("node is not null")
    seen, asked = made.where("node is null").agg(F.sum("n"), F.sum("root")).first()
    comp = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    n = links.groupBy("node").agg(F.sum("n").alias("n"))
    facts = nodes.join(n, "node", "left").join(comp, "node", "left")
    facts = facts.select("k", "label", "v", "node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    good = rows.where("k is not null").join(facts.drop("node"), ["k", "label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("k is null").select("vec_id", F.lit(0).alias("n_links"), F.col("vec_id").alias("component_id"))
    out = good.union(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    recall = F.lit(seen / asked if asked else None).cast("double")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))).withColumn("audit_recall", recall)
