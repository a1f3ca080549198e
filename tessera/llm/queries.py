"""The queries of this subpackage for __spark_entry__.py, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import read


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.hnsw import near_duplicates

    return near_duplicates(read(spark, sf_dir, "embeddings"))


def op2_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.spans import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.warc import derivatives, responses

    return derivatives(responses(read(spark, sf_dir, "pages")))


def op4_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.digest import report

    return report(read(spark, sf_dir, "documents"))


def op5_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.gam import classify

    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import find

    return find(read(spark, sf_dir, "documents"))


def piece_path() -> str:
    """Where the SentencePiece model is, on this machine or an executor's."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pieces import encode

    return encode(read(spark, sf_dir, "documents"), piece_path())


def bpe_path() -> str:
    """Where the byte-level BPE file is, on this machine or an executor's."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pieces

    return pieces(read(spark, sf_dir, "documents"), bpe_path())


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import shard

    return shard(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hnsw, op2_spans, op3_warc, op4_digest, op5_gam, op6_simhash, op7_pii, op8_pieces, op9_packing, op10_sharding)}


def oracle_sql() -> dict[str, str]:
    return {}
