"""The corpus pipeline, stage by stage, against brute force on small tables."""

import os
import zlib

import numpy as np
import pytest

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables aren't here")
def test_pipeline(spark):
    import corpus_pipeline
    from tessera.llm import gam, pii
    from tessera.llm.common import read
    from tests.llm.test_pairs import closure
    from tests.llm.test_shingles import brute_links
    from tests.llm.test_texts import brute_spans

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "pii", "packing"]
    docs = read(spark, DIR, "documents")
    frames, current = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, DIR)
        if name != "packing":
            assert current.columns == docs.columns and dict(current.dtypes) == dict(docs.dtypes)
            current = spark.createDataFrame(current.collect(), docs.schema)
        frames[name] = {}
        for r in current.collect():
            frames[name].setdefault(r.doc_id, []).append(r)

    texts = {r.doc_id: r.text for r in docs.collect()}
    model = gam.train(docs, read(spark, DIR, "labels"))
    ids = sorted(texts)
    score = model.score(np.array([gam.features(texts[i]) for i in ids]))
    kept = {i: texts[i] for i, s in zip(ids, score, strict=True) if s >= 0.3}
    assert set(frames["quality"]) == set(kept) and len(kept) > 0.7 * len(texts)

    low = closure(kept, brute_links(list(kept.items())))
    kept = {i: t for i, t in kept.items() if low[i] == i}
    assert set(frames["near_dedup"]) == set(kept)

    cut = brute_spans([(i, t, None) for i, t in kept.items()], 24)
    got = {i: r[0].text for i, r in frames["substring_dedup"].items()}
    assert got == {i: None if kept[i] is None else cut[i] for i in kept}
    assert all(r[0].n_chars == len(r[0].text) for r in frames["substring_dedup"].values() if r[0].text is not None)

    names = ["email", "ip", "card", "phone"]
    before = spark.createDataFrame([(i, t) for i, t in got.items()], "doc_id long, text string")
    clean = {}
    for r in pii.find(before).collect():
        merged = []
        for a, k, b in sorted((int(x.split(":")[1]), names.index(x.split(":")[0]), int(x.split(":")[2])) for x in r.spans.split(",") if x):
            if merged and merged[-1][2] > a:
                merged[-1][2] = max(b, merged[-1][2])
            else:
                merged.append([a, k, b])
        text, at, out = got[r.doc_id] or "", 0, []
        for a, k, b in merged:
            out += [text[at:a], f"[{names[k].upper()}]"]
            at = b
        clean[r.doc_id] = "".join(out) + text[at:]
    assert {i: r[0].text or "" for i, r in frames["pii"].items()} == clean

    from tokenizers import Tokenizer

    from tessera.llm.queries import bpe_path

    tok = Tokenizer.from_file(bpe_path())
    tok.encode_special_tokens = True
    assert set(frames["packing"]) == set(clean)
    for i, pieces in frames["packing"].items():
        tokens, at = np.array(tok.encode(clean[i], add_special_tokens=False).ids + [1], "<u4"), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(tokens[at : at + r.length].tobytes())
            at += r.length
        assert at == len(tokens) == pieces[0].doc_tokens
    # how documents are cut into pieces depends on the tasks they are dealt to, their ids don't
    whole = corpus_pipeline.run(spark, DIR).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r[0]: r[1] for r in whole} == {i: p[0].doc_tokens for i, p in frames["packing"].items()}
