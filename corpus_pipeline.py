"""A training corpus from raw documents: the stages of the llm subpackage, one after another.

Each stage gets all that the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import gam, packing, pii, shingles, spans
from tessera.llm.common import fresh, read, stash
from tessera.llm.queries import bpe_path


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, counts the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier doesn't reject, as they are.

    Null and empty texts are scored like any others (all features zero), whatever their ids; very long
    ones whole; repeated rows stay or go together, as only the text counts. An empty table gives no
    rows, and without labels of both kinds all rows score alike. Other columns are kept, whatever
    their names."""
    return gam.keep_good(docs, gam.train(docs, read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: texts whose sets of 5-word shingles have a Jaccard
    similarity of 0.8 or more, and all that these connect. It is the row of the smallest id, a null
    id coming after all others.

    Rows are told apart by id and text, so different texts under one id go or stay by themselves; of
    repeated rows (case and white space apart) any one stays. Null, empty and blank texts are copies
    of one another. Texts are compared whole, however long; an empty table gives no rows; other
    columns are kept, whatever their names."""
    found = stash(shingles.near_copies(docs), "components")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("low")
    lows = found.groupBy("component").agg(low).select("low.doc_id", "low.node")
    copies = found.groupBy("node", "doc_id").agg(F.count("*").alias("copies"))
    same = (F.col("l.node") == F.col("c.node")) & F.col("l.doc_id").eqNullSafe(F.col("c.doc_id"))
    kept = stash(lows.alias("l").join(copies.alias("c"), same).select("l.node", "l.doc_id", "copies"), "kept")
    taken = list(docs.columns)
    node, other, copies_of, which = (fresh(taken, n) for n in ("node", "kept_node", "copies", "kept_id"))
    rows = docs.withColumn(node, shingles.node()).join(kept.toDF(other, which, copies_of), (F.col(node) == F.col(other)) & F.col("doc_id").cast("long").eqNullSafe(F.col(which)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = rows.where(F.col(copies_of) == 1).select(*columns)
    # only rows that are repeated need to be met again
    return once.union(rows.where(F.col(copies_of) > 1).dropDuplicates([other, which]).select(*columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, without the sentences of spans that an earlier document has.

    Null and empty texts stay as they are, and a text may become empty; rows under one id are one
    document, those of a null id come after all others; rows alike in id and text lose the same. An
    empty table gives no rows; other columns are kept, whatever their names (n_chars is counted anew,
    and a column n_removed of the input isn't kept)."""
    return _counted(spans.remove_repeats(docs).select(*[F.col(f"`{c}`") for c in docs.columns if c != "n_removed"]))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with personal data replaced by its kind in brackets.

    Null texts stay null, empty ones empty; of candidates that overlap, the best goes first, on ties
    the one that begins first; repeated rows are redacted alike; an empty table gives no rows; other
    columns are kept (n_chars is counted anew)."""
    return _counted(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the tokenised documents, in sequences: columns as op9 has them.

    Null and empty texts are one token; long ones are whole sequences and a rest; null ids and repeated
    rows are packed like any others; an empty table gives no rows; other columns are not looked at."""
    return packing.pieces(docs, bpe_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("pii", redaction),
    ("packing", pack),
]

ORACLE_SQL = None  # a trained model, hashes and a tokenizer: tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
