"""Each stage of the pipeline on rows that a corpus should not have, but may."""

import pytest

from tests.llm.test_texts import brute_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __kid string, copies int, node string"
LONG = "Quite a long sentence number {} with words of its own. "
PROSE = "".join(LONG.format(k) for k in range(12))
ROWS = [(1, PROSE), (1, PROSE), (2, PROSE), (2, "Another text under the same id. It has a second sentence."), (None, None), (None, ""), (None, PROSE.replace(" ", "  ")), (3, "mail jo@x.org or 10.0.0.1"), (4, "y" * 300_000), (5, "one two " * 40_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "kid", 7, "n") for i, t in ROWS], SCHEMA).cache()


def rows(df):
    return sorted(((r.doc_id, r.text, r["__kid"], r.copies, r.node) for r in df.collect()), key=str)


def test_near_dedup(spark, docs):
    import corpus_pipeline

    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    # one of the four rows of the prose, one of the two blank ones, and all others
    assert sorted(kept, key=str) == sorted([(1, PROSE), (2, ROWS[3][1]), *((i, t) for i, t in ROWS if i in (3, 4, 5)), next(k for k in kept if not k[1])], key=str)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").collect() == []


def test_substring_dedup(spark, docs):
    import corpus_pipeline

    got = corpus_pipeline.substring_dedup(spark, docs, "")
    assert got.columns == docs.columns
    out = {}
    for r in got.collect():
        out.setdefault((r.doc_id, len(r.text or "") > 30), []).append(r)
        assert r["__kid"] == "kid" and r.copies == 7 and (r.text is None or r.n_chars == len(r.text))
    assert [r.text for r in out[1, True]] == [PROSE] * 2  # rows alike in id and text are one document
    assert [r.text.strip() for r in out[2, True]] == [ROWS[3][1]] and [r.text for r in out[2, False]] == [""]
    assert sorted(str(r.text) for r in out[None, False]) == ["", "", "None"]
    alone = brute_spans([(5, ROWS[9][1], None)], 24)[5]
    assert out[5, len(alone) > 30][0].text == alone
    assert corpus_pipeline.substring_dedup(spark, docs.limit(0), "").collect() == []


def test_redaction_and_packing(spark, docs):
    import corpus_pipeline

    got = corpus_pipeline.redaction(spark, docs, "")
    assert got.columns == docs.columns
    assert rows(got) == sorted(((i, "mail [EMAIL] or [IP]" if i == 3 else t, "kid", 7, "n") for i, t in ROWS), key=str)
    pieces = corpus_pipeline.pack(spark, docs, "").collect()
    assert {r.doc_id for r in pieces} == {i for i, _ in ROWS} and sum(r.length for r in pieces if r.doc_id is None and r.doc_tokens == 1) == 2
    assert corpus_pipeline.redaction(spark, docs.limit(0), "").count() == corpus_pipeline.pack(spark, docs.limit(0), "").count() == 0


def test_quality(spark, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(i, i % 2, 0) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and set(rows(got)) <= set(rows(docs))
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert kept.count((1, PROSE)) in (0, 2)  # repeated rows stay or go together
    assert corpus_pipeline.quality(spark, docs.limit(0), str(tmp_path)).collect() == []
