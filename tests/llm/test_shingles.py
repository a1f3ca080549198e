"""Near copies by word shingles, against brute force."""

import random

from tests.llm.test_pairs import closure

SCHEMA = "doc_id long, text string"


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_links(rows):
    sets = [(i, brute_set(t)) for i, t in rows]
    return [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[n + 1 :] if len(x & y) >= 0.8 * len(x | y)]


def varied(seed=3, groups=25):
    """Texts, and copies of them with some words changed, chains of copies among them."""
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 30, 150, 400]))]
        for _ in range(rng.randrange(1, 9)):
            out.append(" ".join(words))
            words = words[:]
            for _ in range(rng.randrange(0, 1 + len(words) // 40)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return out + [None, "", " \n", "W1 w2", "w1  W2"]


def test_stage_drops_copies_of_similarity_0_8(spark):
    import corpus_pipeline

    rows = list(enumerate(varied()))
    links = brute_links(rows)
    low = closure([i for i, _ in rows], links)
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert {r.doc_id for r in got.collect()} == {i for i, _ in rows if low[i] == i}
    assert len(links) > 100


def test_large_group_of_copies_is_compared_in_blocks(spark, monkeypatch):
    """Copies of one text, each with some words changed: buckets of hundreds that a pivot doesn't settle."""
    from tessera.llm import shingles

    rng = random.Random(8)
    words = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = [(i, " ".join(f"x{rng.randrange(10**6)}" if rng.random() < 0.022 else w for w in words)) for i in range(300)]
    links = brute_links(rows)
    low = closure([i for i, _ in rows], links)
    assert 20 < len(set(low.values())) < 280
    for block in (8 << 20, 20_000):  # whole buckets, and buckets cut into many blocks
        monkeypatch.setattr(shingles, "BLOCK", block)
        got = shingles.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
        groups = {}
        for r in got:
            groups.setdefault(r.component, set()).add(r.doc_id)
        want = {}
        for i, _ in rows:
            want.setdefault(low[i], set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_empty(spark):
    from tessera.llm.shingles import near_copies

    assert near_copies(spark.createDataFrame([], SCHEMA)).collect() == []


def test_stage_keeps_one_row_of_each_group_whatever_the_ids(spark):
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (2, b), (2, a + " more"), (None, c), (None, c), (None, b), (3, d), (3, d)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, c), (1, a), (2, b), (3, d)]


def brute_meet(x, y):
    """Whether two texts' fingerprints share enough positional bytes, and differ in few enough bits."""
    from tessera.llm import simhash

    for w, (a, b) in enumerate(zip(x, y, strict=True)):
        next_a, next_b = x[(w + 1) % len(x)], y[(w + 1) % len(x)]
        shared = sum((a >> s) & 255 == (b >> s) & 255 for s in range(0, 64, 8))
        if shared >= simhash.SHARED and (a ^ b).bit_count() + (next_a ^ next_b).bit_count() <= simhash.FAR:
            return True
    return False


def test_index_of_several_fingerprints_meets_all_pairs_it_must(spark, monkeypatch):
    """The stage's candidates are op6's: texts that share positional bytes of a SimHash of 5-word shingles."""
    import numpy as np

    from tessera.llm import shingles, simhash

    texts = sorted({" ".join((t or "").lower().split()) for t in varied(seed=5, groups=40)})
    found = [[int(p) for p in simhash.prints(shingles.shingles(t))] for t in texts]
    signed = np.array(found, dtype=np.uint64).view(np.int64).tolist()
    schema = ", ".join(["node long", *(f"p{i} long" for i in range(simhash.PRINTS))])
    frame = spark.createDataFrame([(n, *p) for n, p in enumerate(signed)], schema)
    must = {(a, b) for a in range(len(texts)) for b in range(a) if brute_meet(found[a], found[b])}
    near = {(a, b) for b, a in brute_links(list(enumerate(texts)))}
    assert len(near) > 100 and near <= must
    for held, deal in ((1 << 16, 8192), (16, 50)):  # a task for each byte, and one for some of its values
        monkeypatch.setattr(simhash, "HELD", held)
        monkeypatch.setattr(simhash, "DEAL", deal)
        groups = {}
        for r in simhash.meetings(frame).collect():
            groups.setdefault(r.k, set()).add(r.node)
        met = {(a, b) for g in groups.values() for a in g for b in g if b < a}
        assert must <= met and len(met) < 2 * len(must)


def test_fingerprint_bit_is_set_in_over_half_the_shingles():
    import numpy as np

    from tessera.llm import simhash

    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 240, 241, 700):
        found = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for seed, got in zip(simhash._SEEDS, simhash.prints(found), strict=True):
            x = (found ^ seed) * simhash._MIX
            x = (x ^ x >> np.uint64(32)) * simhash._MIX2
            x ^= x >> np.uint64(32)
            assert int(got) == sum(1 << i for i in range(64) if 2 * sum(int(v) >> i & 1 for v in x) > n)


def test_long_entry_connects_what_its_pairs_connect(monkeypatch):
    import numpy as np

    from tessera.llm import simhash

    rng = np.random.default_rng(9)
    rows = rng.integers(0, 1 << 63, (12, 3), dtype=np.uint64).repeat(60, axis=0)
    for _ in range(10):  # some are nearer to others of their dozen than FAR bits, some aren't
        rows[:, 1] ^= np.uint64(1) << rng.integers(0, 64, len(rows), dtype=np.uint64)
        rows[:, 0] ^= np.uint64(1) << rng.integers(0, 40, len(rows), dtype=np.uint64)
    rows[:, 2] = np.arange(len(rows), dtype=np.uint64)
    rows[:, 0] = rows[:, 0] & ~np.uint64(0xFFFF << 48) | np.uint64(7 << 48)
    groups = []
    for listed in (10**6, 5):
        monkeypatch.setattr(simhash, "LISTED", listed)
        found = {}
        for k, node in zip(*(x.tolist() for x in simhash._met(rows, 6)), strict=True):
            found.setdefault(k, set()).add(node)
        groups.append(found)
    assert groups[0] == groups[1] and 2 <= len(groups[0]) < 700


def test_small_sets_meet_exactly(spark, monkeypatch):
    """Eight words and a ninth: sets of four and five shingles, which fingerprints might miss."""
    from tessera.llm import shingles, simhash

    monkeypatch.setattr(simhash, "meetings", lambda rows: rows.selectExpr("0L AS k", "node").limit(0))
    rows = [(2 * i + j, " ".join(f"w{i}x{k}" for k in range(n + j))) for i, n in enumerate(range(1, 20)) for j in (0, 1)]
    low = {}
    for r in shingles.near_copies(spark.createDataFrame(rows, SCHEMA)).collect():
        low.setdefault(r.component, set()).add(r.doc_id)
    joined = {min(g) // 2 + 1 for g in low.values() if len(g) == 2}
    # n words have n - 4 shingles; the index is switched off here, so longer texts stay apart
    assert joined == set(range(8, 13))


def variants(n, seed=8, share=0.04):
    """Texts with some words of one changed: near one another, few of them near enough."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(5000)}" for _ in range(120)]
    return [(i, " ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in words)) for i in range(n)]


def test_text_of_a_large_group_is_dealt_a_bounded_number_of_times(spark, monkeypatch):
    """Whatever the buckets it is in, and however many others are in them."""
    from tessera.llm import shingles

    seen, between = [], shingles._between
    monkeypatch.setattr(shingles, "_between", lambda rest, least: seen.append(rest) or between(rest, least))
    rows = variants(200)
    got = shingles.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    low = closure([i for i, _ in rows], brute_links(rows))
    assert len({(low[r.doc_id], r.component) for r in got}) == len(set(low.values())) == len({r.component for r in got})
    texts = seen[0].select("node").distinct().count()
    assert seen[0].count() == texts > 100
    monkeypatch.setattr(shingles, "TEXTS", 8)
    for most in (1, 4, 16):
        monkeypatch.setattr(shingles, "MOST", most)
        assert shingles._dealt(seen[0]).count() <= most * texts


def test_different_short_texts_do_not_meet(spark, monkeypatch):
    from tessera.llm import shingles

    seen, between = [], shingles._between
    monkeypatch.setattr(shingles, "_between", lambda rest, least: seen.append(rest) or between(rest, least))
    rows = [(i, f"a{i} b{i} c{i}") for i in range(60)]
    got = shingles.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len({r.component for r in got}) == 60
    assert seen[0].count() == 0


def test_sets_linked_within_a_task_are_those_of_brute_force():
    import numpy as np
    import pyarrow as pa

    from tessera.llm import shingles

    rng, joined = np.random.default_rng(2), 0
    for _ in range(40):
        base, sets = np.arange(rng.integers(1, 45)), []
        for _ in range(30):
            kept = base[rng.random(len(base)) > rng.choice([0, 0.1, 0.2])]
            sets.append(np.unique(np.concatenate([kept, rng.integers(100, 10**6, rng.integers(0, 4)), base[:1]])))
        roots = rng.integers(0, 20, len(sets))
        t = pa.table({"node": np.arange(len(sets)), "root": roots, "shingles": pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))})
        pairs = [(a, b) for a in range(30) for b in range(a) if 10 * len(np.intersect1d(sets[a], sets[b])) >= 8 * len(np.union1d(sets[a], sets[b]))]
        alike = [(a, b) for a in range(30) for b in range(a) if roots[a] == roots[b]]
        left, right = (x.tolist() for x in shingles._linked(t, 0.8))
        assert {(max(p), min(p)) for p in zip(left, right, strict=True)} <= set(pairs)
        assert closure(range(30), [*alike, *zip(left, right, strict=True)]) == closure(range(30), [*alike, *pairs])
        joined += len(left)
    assert joined > 100
