"""Proportional stratified interleaving [DataFrame functions only].

Rows are ranked in a seeded shuffle within their stratum, sorted by fractional rank and cut into
shards, so each shard has every stratum's share of rows (one row more or less) and shard counts
differ by one at most (law `rows`). No rank needs a whole stratum or table in one task: ranks are
a prefix sum over hash buckets plus a row number within a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stash

#: Rows aimed at in a bucket, and most buckets. Beyond that buckets grow; no row is dropped.
BUCKET_ROWS, MOST_BUCKETS = 1024, 1 << 20
#: Repeats of one row that are made in one go.
CHUNK = 4096


def _bits(rows: int) -> int:
    return max(1, min(MOST_BUCKETS, -(-rows // BUCKET_ROWS)) - 1).bit_length()


def shard(docs: DataFrame, shards: int = 24, stratum: str = "source", text: str = "text", seed: int = 20) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, stratum) for every row of docs.

    Null texts have size 8 and the checksum of no bytes; a null stratum is a stratum of its own;
    rows alike in id, text and stratum are one row with a count until their ranks are known, so that
    repeats don't gather in one task, and take adjacent ranks; an empty table gives no rows; other
    columns are not looked at. Equal texts may go to different shards: the law kept is `rows`."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.col(stratum).cast("string").alias("stratum"),
    )
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"))
    rows = stash(rows.groupBy("doc_id", "size", "text_crc32", "stratum", "h").agg(F.count("*").alias("copies")), "rows")
    total = rows.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    bits = _bits(total)
    key = F.coalesce(F.concat(F.lit("="), F.col("stratum")), F.lit(""))  # null apart from any string
    rows = rows.withColumn("s", key).withColumn("b", F.shiftrightunsigned("h", 64 - bits))

    counts = rows.groupBy("s", "b").agg(F.sum("copies").alias("n"))
    in_s = Window.partitionBy("s")
    before = F.sum("n").over(in_s.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    start = counts.select("s", "b", before.alias("before"), F.sum("n").over(in_s).alias("n_s"))
    # h, but as unsigned: within a bucket its top bits are equal, so signed order is unsigned order
    here = Window.partitionBy("s", "b").orderBy("h", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("n", F.sum("copies").over(here) - F.col("copies")).join(start, ["s", "b"])
    # rows with counts become as many rows again, chunk by chunk
    ranked = ranked.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (copies - 1) div {CHUNK})"))).repartition("h", "chunk")
    ranked = ranked.withColumn("copy", F.explode(F.expr(f"sequence(chunk * {CHUNK}, least(copies, (chunk + 1) * {CHUNK}) - 1)")))
    shift = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "s"), 11).cast("double") + 0.5) / float(1 << 53)
    ranked = ranked.withColumn("at", (F.col("before") + F.col("n") + F.col("copy") + shift) / F.col("n_s"))
    ranked = ranked.withColumn("cut", F.least(F.lit((1 << bits) - 1), F.floor(F.col("at") * (1 << bits))).cast("long"))
    ranked = stash(ranked.select("doc_id", "size", "text_crc32", "stratum", "s", "h", "at", "cut"), "ranked")

    sums = ranked.groupBy("cut").agg(F.count("*").alias("n"))
    sums = sums.select("cut", (F.sum("n").over(Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    n = F.row_number().over(Window.partitionBy("cut").orderBy("at", "s", "h", "doc_id", "text_crc32", "size")) - 1
    placed = ranked.withColumn("n", n).join(sums, "cut").withColumn("rank", F.col("before") + F.col("n"))
    number: Column = F.expr(f"(rank * {shards}L) div {max(total, 1)}L")
    placed = placed.withColumn("shard", number.cast("int"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.expr(f"rank - (shard * {total}L + {shards - 1}L) div {shards}L").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "stratum",
    )
