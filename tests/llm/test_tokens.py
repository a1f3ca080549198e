"""Lattice sampling (op8), packing (op9) and WARC derivatives (op3)."""

import gzip
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import packing, pieces, warc
from tessera.llm.queries import bpe_path, piece_path

public = pytest.importorskip("public_tokenizers")
TEXTS = [None, "", " ", "Hello world", "  two  spaces\n\nand\tlines ", "été 𝒜   漢字", "x" * 20_000, "a \x00 b", "<|endoftext|> is text", "don't  stop it's ", "Word " * 3000]
D = "doc_id long, text string, ids string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], D)


def test_pieces_round_trip(spark):
    df = frame(spark, TEXTS)
    got = {r.doc_id: r for r in pieces.encode(df, piece_path()).collect()}
    assert all(r.lossless and r.n_pieces == len(r.ids) for r in got.values()) and got[0].ids == [] == got[1].ids
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(df, piece_path()), piece_path()).collect()}
    assert [back[i] for i in range(len(TEXTS))] == [t or "" for t in TEXTS]
    alone = {r.doc_id: r.ids for i in (4, 9) for r in pieces.encode(df.where(f"doc_id = {i}"), piece_path()).collect()}
    assert all(alone[i] == got[i].ids for i in alone)  # whatever is encoded along with it
    assert pieces.encode(df, piece_path(), seed=9).where("doc_id = 3").first().ids != got[3].ids or pieces.encode(df, piece_path(), seed=10).where("doc_id = 3").first().ids != got[3].ids
    assert pieces.encode(df.limit(0), piece_path()).count() == 0


def test_samples_follow_the_lattice():
    """Frequencies of whole segmentations against the product of their weights."""
    v = pieces.Pieces(piece_path())
    weights = {}
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=piece_path())
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
            weights[sp.id_to_piece(i).replace("▁", " ")] = (i, 1 / (2 + max(0.0, -sp.get_score(i))))

    def ways(word):
        if not word:
            return {(): 1.0}
        out = {}
        for n in range(1, len(word) + 1):
            if word[:n] in weights:
                i, w = weights[word[:n]]
                for rest, x in ways(word[n:]).items():
                    out[(i, *rest)] = w * x
        return out

    want = ways(" then")
    total = sum(want.values())
    n = 20_000
    ids, cuts = v.sample(["then"] * n, list(range(n)), 8)
    got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    assert set(got) <= set(want)
    for path, w in want.items():
        p = w / total
        assert abs(got[path] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4


def test_tokenizer_matches_the_file():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe_path())
    tok.encode_special_tokens = True
    run = packing.tokenizer(bpe_path())
    rng = np.random.default_rng(1)
    alphabet = list("abcXYZ  ..,'!\n\t019éß漢𝒜  -") + ["'s", " the", "  ", "\r\n", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 80))) for _ in range(1500)] + [t or "" for t in TEXTS] + ["".join(rng.choice(alphabet, 30_000))]
    for t in texts:
        assert np.frombuffer(run(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t[:200]


def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe_path())
    tok.encode_special_tokens = True
    rng = np.random.default_rng(2)
    texts = TEXTS + [" ".join(rng.choice(["one", "two", "three", "hyperbola"], rng.integers(1, 900))) for _ in range(150)]
    got = packing.pieces(frame(spark, texts), bpe_path()).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    loads = []
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        loads.append(at)
    assert len(loads) * 2048 - sum(loads) <= 2048 * 4  # at most a window's worth in each task
    assert packing.pieces(frame(spark, []), bpe_path()).count() == 0


def test_differencing():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 2000, 300).tolist()
    k = -(-sum(sizes) // 2048)
    groups = packing.difference(sizes, k)
    sums = [sum(sizes[i] for i in g) for g in groups]
    assert sorted(i for g in groups for i in g) == list(range(300)) and max(sums) - min(sums) < 200
    assert packing.difference([], 3) == [[], [], []] and packing.difference([5], 1) == [[0]]
    for sizes in (sizes, [2048] * 5, [2047, 2047, 2], [1], [1500] * 40, rng.integers(1, 2048, 700).tolist()):
        windows = packing.pack(sizes)
        assert len(windows) == -(-sum(sizes) // 2048) and all(sum(n for _, _, n in w) <= 2048 for w in windows)
        covered = {i: sorted((s, n) for w in windows for j, s, n in w if i == j) for i in range(len(sizes))}
        for i, size in enumerate(sizes):
            at = 0
            for start, n in covered[i]:
                assert start == at and n > 0
                at += n
            assert at == size


def test_window_count_rises_before_anything_is_cut():
    """Seven items of 1100 need seven windows whole; as four hold them, three are cut to fill the padding."""
    assert max(sum(1100 for _ in g) for g in packing.difference([1100] * 7, 4)) > 2048
    windows = packing.pack([1100] * 7)
    assert len(windows) == 4 and sum((0, 1100) == (s, n) for w in windows for _, s, n in w) == 4


def test_warc(spark):
    page = "<html><head><title>A &amp; B</title><script>no()</script></head><body><p>One  two</p><a href='/x?q=1'>link</a><br>é</body></html>"
    rows = [(1, "http://h.org/d/", page, "r"), (2, None, None, "r"), (3, "http://h.org/", "", "r"), (4, "http://h.org/", "<" * 50_000, "r"), (1, "http://h.org/d/", page, "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record string")
    got = warc.derivatives(warc.responses(df)).collect()
    assert len(got) == 2 * len(rows) and len({r.record_id for r in got}) == 2 * (len(rows) - 1)
    source = {k: head for k, head in ((r.page_id, next(warc.records(bytes(r.record)))[0]) for r in warc.responses(df).collect())}
    for r in got:
        head, block = next(warc.records(bytes(r.record)))
        assert warc.get(head, "WARC-Refers-To") == warc.get(source[r.page_id], "WARC-Record-ID") == r.refers_to
        assert warc.get(head, "WARC-Refers-To-Payload-Digest") == warc.get(source[r.page_id], "WARC-Payload-Digest") == r.source_digest
        assert warc.digest(block) == r.block_digest and r.digest_ok and int(warc.get(head, "Content-Length")) == len(block) == r.content_length
    one = {r.warc_type: r.block for r in got if r.page_id == 1}
    assert one["conversion"] == "One two\nlink\né"
    assert "title: A & B" in one["metadata"] and "outlink: http://h.org/x?q=1" in one["metadata"] and "source-content-type: text/html; charset=utf-8" in one["metadata"]
    assert warc.derivatives(warc.responses(df.limit(0))).count() == 0


def test_warc_files(spark):
    one, two = warc.response("1", "http://a/", "<p>x</p>"), warc.response("2", "http://b/", "<p>y</p>")
    other = warc.serialise([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:x>")], b"GET")
    data = [(1, one + other + two), (2, gzip.compress(one) + gzip.compress(two)), (3, gzip.compress(one + two)), (4, b"nonsense"), (5, None), (6, one[:-30]), (7, two.replace(b"<p>y", b"<p>z"))]
    got = warc.derivatives(spark.createDataFrame([(k, bytearray(d) if d is not None else None) for k, d in data], "page_id long, record binary")).collect()
    assert Counter(r.page_id for r in got) == {1: 4, 2: 4, 3: 4, 7: 2}
    assert not any(r.digest_ok for r in got if r.page_id == 7)
    whole = spark.createDataFrame([(k, bytearray(d) if d is not None else None) for k, d in data] + [(8, bytearray(one[:-30] + b"\r\n" + two + b"rubbish\r\n" + one)), (9, bytearray(gzip.compress(one)[:-20]))], "page_id long, record binary")
    told = {r.page_id: (r.n_records, r.n_damaged) for r in warc.damage(whole).collect()}
    assert told == {1: (3, 0), 2: (2, 0), 3: (2, 0), 4: (0, 1), 5: (0, 0), 6: (0, 1), 7: (1, 0), 8: (2, 2), 9: (0, 1)}
    assert warc.derivatives(whole.where("page_id = 8")).count() == 4  # reading goes on after what is damaged
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Type: text/html; charset=latin-1\r\n\r\n3\r\n<p>\r\n1\r\n\xe9\r\n0\r\n\r\n"
    assert [r[8] for r in warc.derive([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:y>")], chunked)][1] == "é"


def test_warc_pages_that_never_end_an_element():
    """Megabytes of elements that are never closed take one way forward, not one for each."""
    import time

    start = time.time()
    for body in (b"<title>" * 400_000, b"<title" * 400_000, b"<script " * 300_000, b"<meta " * 400_000, b"<a href=" * 300_000, b"<p>" * 10 + b" " * 2_000_000):
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
        meta, text = warc.derive([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:y>")], http)
        assert "title:" not in meta[8]
    assert time.time() - start < 60
    late = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + b"<!-- " + b"x" * 10_000 + b" --><meta charset=latin-1><title>a</title><title>b</title>\xe9"
    meta, text = warc.derive([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:y>")], late)
    assert "charset: latin-1" in meta[8] and "title: a\r\n" in meta[8] and text[8] == "é"


def test_long_text_without_spaces_is_bounded():
    """One lattice for a text of one word; it doesn't outlive the next batch that needs room."""
    v = pieces.Pieces(piece_path())
    texts = ["漢字かな交じり文" * 50_000, "ab" * 200_000]
    ids, cuts = v.sample(texts, [1, 2], 8)
    assert v.lossless(ids, cuts, texts) == [True, True] and not all(v.lossless(ids, cuts, [texts[0], texts[1][:-1] + "c"]))
    kept, pieces.KEPT = pieces.KEPT, 1000
    try:
        v.sample(["something else"], [1], 8)
    finally:
        pieces.KEPT = kept
    assert len(v.first) < 100
