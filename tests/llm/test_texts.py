"""Digests (op4), PII (op7), sharding (op10), spans (op2) and the classifier (op5)."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import digest, gam, pii, sharding, spans

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kid string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "k") for i, t, s in rows], DOCS)


TEXTS = [None, "", "  ", "Straße ﬁn", "STRASSE   fin\n", "ab", "abc", "x" * 70_000, "été à 𝒜", "plain words here", "plain  words\there "]


def test_digest(spark):
    rows = [(10 + i, t, "a") for i, t in enumerate(TEXTS)]
    df = docs(spark, rows)
    got = {r.doc_id: r for r in digest.report(df).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t, _) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + nxt[:n]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].near_edited == float(got[i].fingerprint == got[i].edited_fingerprint)
        assert got[i].near_next == float(got[i].fingerprint == got[order[(k + 1) % len(order)][0]].fingerprint)
    same = [{10, 11, 12}, {13, 14}, {19, 20}]
    for group in same:
        assert len({got[i].fingerprint for i in group}) == 1 and {got[i].group_id for i in group} == {min(group)}
    assert len({r.fingerprint for r in got.values()}) == len(rows) - 4
    twice = digest.report(df.union(df.where("doc_id = 15")))
    assert sorted(r.edited_sha256 for r in twice.where("doc_id = 15").collect()) == [got[15].edited_sha256] * 2
    assert digest.report(df.limit(0)).count() == 0
    alone = digest.report(docs(spark, [(1, "abcdef", "a")])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and alone.near_next == 1.0


def test_equal_buckets_are_compared_by_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(digest, "digests", lambda form: (F.lit(1).cast("long"), F.lit(2).cast("long")))
    rows = [(1, "a", "x"), (2, "b", "x"), (3, "A ", "x"), (4, "bbc", "x"), (5, "bba", "x"), (6, "b bb", "x")]
    got = {r.doc_id: r for r in digest.report(docs(spark, rows)).collect()}
    assert got[1].fingerprint == got[3].fingerprint and len({r.fingerprint for r in got.values()}) == 5
    # 5 becomes "bbb": no document's form; 4 becomes "bbA", which is 5's form, and has its fingerprint
    assert got[4].edited_fingerprint == got[5].fingerprint and got[4].near_edited == 0 == got[4].near_next


def test_digest_of_many_null_ids_and_uneven_ids(spark, monkeypatch):
    monkeypatch.setattr(digest, "BUCKET_ROWS", 3)
    monkeypatch.setattr(digest, "PARTS", 4)
    rows = [(None, f"null {i}", "s") for i in range(40)] + [(i if i < 60 else i * 10**12, f"text {i} with words", "s") for i in range(80)]
    got = digest.report(docs(spark, rows)).collect()
    bodies = sorted(((i, t) for i, t, _ in rows if i is not None), reverse=True)
    want = {}
    for k, (i, t) in enumerate(bodies[:-1]):
        n = len(t) // 3
        want[i] = hashlib.sha256((t[: len(t) - n] + bodies[k + 1][1][:n]).encode()).hexdigest()
    assert all(r.edited_sha256 == want[r.doc_id] for r in got if r.doc_id is not None and r.doc_id != bodies[-1][0])
    # null ids follow one another in some order, each of their texts once, then the first of all
    ends = [r for r in got if r.doc_id is None]
    heads = {hashlib.sha256((f"null {i}"[: len(f"null {i}") - len(f"null {i}") // 3] + x).encode()).hexdigest() for i in range(40) for x in ("nu", "te")}
    assert len(ends) == 40 and all(r.edited_sha256 in heads for r in ends)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(body):
    d = [int(c) for c in reversed(body) if c.isdigit()]
    return sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(d)) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            n = len(re.sub("[^0-9]", "", m[0]))
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= n <= 19 and luhn(m[0]), "phone": 9 <= n <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_pii_base(spark):
    rng = random.Random(4)
    parts = ["a@b.c", "a.b%c@d-e.f.g_h@i.jk", "x@y", "@q.r", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1.2", "0255.001.0.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "12 4111 1111 1111 1111"]
    parts += ["+1 (555) 123-4567", "+44 20 7946 0958.", "+1", "+12345678901234567890", "555-123-4567", "é𝒜", " ", ", ", "word", "9", "-", "x [at] y [dot] org", "a@" + "b." * 3000 + "c", "7 " * 50, "1" * 500]
    texts = [None, ""] + ["".join(rng.choice(parts) + rng.choice(["", " ", "x"]) for _ in range(rng.randrange(1, 12))) for _ in range(250)] + ["a" * 100_000, "1 " * 50_000, "+" + "1 (" * 20_000, "a@b" + ".c" * 40_000]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in pii.find(docs(spark, rows)).collect()}
    for i, t, _ in rows:
        want = base_spans(t or "")
        text = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (t or "")[:300]
        n = Counter(x[3] for x in want)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(n[k] for k in BASE)
        assert set(filter(None, text.split(","))) <= set(got[i].spans.split(","))
    assert pii.find(docs(spark, [])).count() == 0


def test_pii_candidates_and_redaction(spark):
    rows = [(1, "write to jo [at] mail [dot] org or call (555) 123-4567 today", "s"), (2, "call +1 (555) 123-4567 10.0.0.1, mail a@b.org", "s"), (3, "build 123456 of 2024", "s"), (4, None, "s")]
    found = {r.doc_id: r.spans for r in pii.find(docs(spark, rows)).collect()}
    assert "email:" in found[1] and "phone:" in found[1] and found[3] == ""
    clean = pii.redact(docs(spark, rows))
    assert clean.columns == docs(spark, rows).columns
    text = {r.doc_id: r.text for r in clean.collect()}
    assert text[1] == "write to [EMAIL] or call [PHONE] today" and text[3] == rows[2][1] and text[4] is None
    assert "555" not in text[2] and "10.0.0.1" not in text[2] and "a@b" not in text[2]


def test_pii_model_is_the_same_in_expressions_and_in_numpy(spark):
    """Features and scores of candidates by Spark against those that fitting uses; the greedy choice
    against a plain one; a long list of numbers."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    model = pii.fitted()
    parts = ["+1 (555) 123-4567", "555-123-4567", "4111 1111 1111 1111", "4111111111111112", "378282 246310 005", "jo [at] x [dot] org", "tel: ", "card ", "no. ", "x", " ", ", ", "(555) 123-4567", "5555-4444-3333-2222"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 10))) for _ in range(200)] + ["call (555) 123-4567 " * 1500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    body = F.col("text")
    low = pii.Model(model.bias, model.trees, [-1e9] * 4)  # every candidate
    got = df.select("doc_id", pii.candidates(body, low).alias("c"), pii.base_spans(body).alias("b"), pii.all_spans(body, pii.base_spans(body), model).alias("s")).collect()
    for r in got:
        text = texts[r.doc_id]
        for c in r.c if r.doc_id < 200 else r.c[:50]:
            f = pii.features(c.kind, text[c.start : c.end], text[max(0, c.start - pii.CONTEXT) : c.start], text[c.end : c.end + 1])
            assert abs(model.score(np.array([f], dtype=float))[0] - c.score) < 1e-9, (text, c)
        chosen = [(s.start, s.kind, s.end) for s in r.b]
        for score, start, kind, end in sorted({(-c.score, c.start, c.kind, c.end) for c in r.c if c.score >= model.thresholds[c.kind]}) if r.doc_id < 200 else []:
            if not any(a < end and start < b for a, _, b in chosen):
                chosen.append((start, kind, end))
        if r.doc_id < 200:
            assert [(s.start, s.kind, s.end) for s in r.s] == sorted(chosen)
        else:
            assert len(r.s) == 1500


def test_sharding(spark):
    rng = random.Random(1)
    rows = [(i, f"t{i}", rng.choice(["big"] * 6 + ["b", "c", None])) for i in range(1200)] + [(7, "t7", "big")] * 50 + [(None, None, None)]
    got = sharding.shard(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    count = Counter(r.shard for r in got)
    assert set(count) == set(range(24)) and max(count.values()) - min(count.values()) <= 1
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    for source in ("big", "b", "c", None):
        n = Counter(r.shard for r in got if r.stratum == source)
        assert max(n.values()) - min(n[s] for s in range(24)) <= 2
    for r in got:
        body = f"t{r.doc_id}" if r.doc_id is not None else ""
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(body) + 8, zlib.crc32(body.encode()), "rows", None)
    assert sharding.shard(docs(spark, [])).count() == 0
    repeats = sharding.shard(docs(spark, [(None, "x", "s")] * 10_000 + [(1, "y", "s")])).groupBy("shard").count().collect()
    assert len(repeats) == 24 and {r["count"] for r in repeats} == {416, 417}


def brute_sentences(text):
    """(start, end, words) by looking at every run of white space."""
    runs = [(m.start(), m.end()) for m in re.finditer(r"\s+", text)]
    before = lambda k: text[k - 1] if k else "-"
    natural = [b for a, b in runs if "\n" in text[a:b] or before(a) in ".!?…。！？" or re.match("[A-ZÀ-ÖØ-Þ¿¡]", text[b : b + 1])]
    out, at = [], 0
    for end in [*natural, len(text)]:
        long = len(text[at:end].split()) > 20
        for stop in [*(b for a, b in runs if long and at < a and b < end and before(a) in ",;:，；："), end]:
            words = tuple(text[at:stop].lower().split())
            if words:
                out.append((at, stop, words))
                at = stop
    return out


def brute_spans(rows, longest=None):
    """Texts without sentences covered by a run of several sentences, of 20 words or more, that has
    occurred before: every run is looked at (or those of up to `longest` sentences)."""
    seen, out = set(), []
    for i, text, _ in sorted(rows, key=lambda r: r[0]):
        text = text or ""
        found = brute_sentences(text)
        gone = bytearray(len(text))
        own = set()
        for a in range(len(found)):
            words = found[a][2]
            for b in range(a + 1, min(len(found), a + (longest or len(found)))):
                words += found[b][2]
                if len(words) >= 20:
                    key = hash((b - a, *(f[2] for f in found[a : b + 1])))
                    if key in seen or key in own:
                        gone[found[a][0] : found[b][1]] = b"x" * (found[b][1] - found[a][0])
                    own.add(key)
        seen |= own
        out.append((i, "".join(c for c, g in zip(text, gone, strict=True) if not g)))
    return dict(out)


def test_spans(spark):
    rng = random.Random(2)
    sentence = lambda: " ".join(rng.choice("abcdefghij") * rng.randrange(1, 6) + rng.choice(["", "", "", ","]) for _ in range(rng.choice([3, 4, 8, 15, 30]))).capitalize() + ". "
    shared = ["".join(sentence() for _ in range(8)) for _ in range(3)] + [", ".join(f"p{k} q{k} r{k}" for k in range(20)) + ". "]
    rows = [(i, "".join(sentence() for _ in range(5)) + rng.choice([*shared, "", "short Again. Short again.\n"]) + "".join(sentence() for _ in range(4)), "s") for i in range(40)]
    rows += [(100, rows[0][1], "s"), (101, shared[0] + shared[0], "s"), (102, "", "s"), (103, None, "s"), (104, "one. two. " * 60, "s")]
    df = docs(spark, rows)
    got = {r.doc_id: r for r in spans.remove_repeats(df).collect()}
    want = brute_spans(rows)
    assert len(got) == len(rows) and got[103].text is None
    for i, t, _ in rows:
        assert (got[i].text or "") == want[i] and got[i].n_removed == len(t or "") - len(want[i])
    assert got[100].text == "" and got[5].source == "s" and got[104].n_removed > 400
    assert spans.remove_repeats(df.limit(0)).count() == 0


def test_spans_of_odd_rows(spark):
    """Null ids are told apart by text, columns of helper names are kept, a very long text is cut whole."""
    passage = "".join(f"Word{k} and some more words of sentence {k}. " for k in range(8))
    schema = "doc_id long, text string, __kid string, __crc long, cuts string, kid int, n_removed string, h1 double"
    rows = [(None, "Alpha beta. " + passage, "k", 1, "c", 2, "n", 0.5), (None, "Gamma delta. " + passage, "k", 1, "c", 2, "n", 0.5), (1, passage + "Own end here.", "k", 77, None, 2, "n", 0.5)]
    rows += [(1, "A different text under the id. " + passage, "k", 77, None, 2, "n", 0.5), (2, "x " * 200_000 + passage, None, None, None, None, None, None)]
    got = spans.remove_repeats(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "__kid", "__crc", "cuts", "kid", "h1", "n_removed"]
    out = sorted(((r.doc_id, r.text, r["__crc"], r.n_removed) for r in got.collect()), key=str)
    assert {(i, t.strip()[:30], c) for i, t, c, _ in out} == {(None, "Alpha beta.", 1), (None, "Gamma delta.", 1), (1, passage[:30], 77), (1, "A different text under the id.", 77), (2, ("x " * 200)[:30], None)}
    assert [n for i, _, _, n in out if i == 1] == [0, 0] and all(n >= len(passage) - 1 for i, _, _, n in out if i != 1)


def test_classifier(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["water", "house", "light", "green", "river", "stone"]) + rng.choice(["", "", ","]) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice(["###", "BUY", "$$$", "click!!", "77 88", "||"]) for _ in range(60))
    rows = [(i, good() if i % 2 else bad(), "s") for i in range(400)] + [(1000, None, "s"), (1001, "", "s"), (1002, "x" * 50_000, "s"), (None, good(), "s")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = gam.classify(docs(spark, rows), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id is not None and r.doc_id < 400:
            assert r.predicted == r.doc_id % 2
    assert gam.classify(docs(spark, rows[:5]), labels.limit(0)).count() == 5
    assert gam.classify(docs(spark, []), labels).count() == 0


def brute_tree(g, h, n):
    """All cuts of ordered bins into three leaves or fewer, the one of the greatest gain."""
    b, best = len(g), (1e-9 + g.sum() ** 2 / (h.sum() + 1), ())
    ways = [(p,) for p in range(1, b)] + [(p, q) for p in range(1, b) for q in range(p + 1, b)]
    for cuts in ways:
        leaves = list(zip((0, *cuts), (*cuts, b), strict=True))
        if all(n[s:e].sum() >= gam.MIN_ROWS for s, e in leaves):
            gain = sum(g[s:e].sum() ** 2 / (h[s:e].sum() + 1) for s, e in leaves)
            if gain > best[0] + 1e-9:
                best = (gain, cuts)
    return best


def test_trees_and_tables_against_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(60):
        b = int(rng.integers(1, 9))
        n = rng.integers(0, 12, b)
        g, h = rng.normal(size=b) * np.sqrt(n), n * 0.2
        step = gam._tree(g, h, n)
        gain, cuts = brute_tree(g, h, n)
        leaves = list(zip((0, *cuts), (*cuts, b), strict=True))
        if len(set(np.round(step, 12))) > 1 or cuts:
            got = sum(g[s:e].sum() * step[s] for s, e in leaves) if all(np.allclose(step[s:e], step[s]) for s, e in leaves) else None
            assert got is not None and abs(got - sum(g[s:e].sum() ** 2 / (h[s:e].sum() + 1) for s, e in leaves)) < 1e-9
    x = rng.random((300, len(gam.FEATURES)))
    model = gam.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.7).astype(float))
    got = model.score(x)
    for row, score in zip(x[:50], got[:50], strict=True):
        z = model.bias
        for j, t in enumerate(model.tables):
            z += t[sum(row[j] >= e for e in model.edges[j])]
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            z += t[sum(row[i] >= e for e in model.coarse[i])][sum(row[j] >= e for e in model.coarse[j])]
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-9


def test_pair_tables_learn_interactions():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.9


@pytest.mark.parametrize("dir", ["/root/testdata/sf0.01"])
def test_held_out_quality(spark, dir):
    import os

    if not os.path.isdir(dir):
        pytest.skip("the driver's tables aren't here")
    labels = spark.read.parquet(f"{dir}/labels.parquet")
    got = gam.classify(spark.read.parquet(f"{dir}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").select("score", "quality").toPandas()
    good, bad = got.score[got.quality == 1].to_numpy(), got.score[got.quality == 0].to_numpy()
    auc = (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()
    assert auc > 0.9
