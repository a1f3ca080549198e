"""Helpers that the operators share: shared-folder tables, components, text edits."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share, spark.checkpoint.dir;
    where that is unset, as in tests, a temporary one, if driver and executors are one machine. It is
    deleted when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own[app] = f"{(named or tempfile.mkdtemp(prefix='tessera-')).rstrip('/')}/tessera-{app}"
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(_own[app])
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return _own[app]


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: its lineage ends there, so a
    lost executor costs no recomputation, and the plan above it is computed once only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path  # type: ignore[attr-defined]
    return out


def unstash(df: DataFrame) -> None:
    """Delete what stash() wrote, once nothing reads it any more."""
    path = getattr(df, "_stash_path", None)
    if path:
        jvm, sc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def fresh(taken: list[str], name: str) -> str:
    """name, or a longer one that no column has, in whatever case."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


#: Rows of whole texts that are handed to Python at once.
BATCH = 2000


def small_batches(spark: SparkSession) -> None:
    """From now on Python gets at most BATCH rows at once, unless the session asks for fewer: a batch
    is held several times over, on either side, and texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH:
        spark.conf.set(name, str(BATCH))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a long, b long): rows (node, component) for
    every node that isn't the smallest of its component.

    Alternating large-star and small-star rounds (Kiveris et al., 2014); each round keeps at
    most as many edges as the last, cut off by a written table. Self-loops, repeated edges and
    nulls are ignored; no edges give no rows."""
    cur = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur = stash(cur, "edges")
    mark = _mark(cur)
    while mark[0]:
        both = cur.union(cur.select(F.col("v"), F.col("u"))).toDF("u", "n")
        low = both.groupBy("u").agg(F.least(F.min("n"), F.first("u")).alias("m"))
        large = both.where("n > u").join(low, "u").select(F.col("n").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.inline(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        new = stash(small.where("u <> v").distinct(), "edges")
        seen, mark = mark, _mark(new)
        unstash(cur)
        cur = new
        if mark == seen:
            break
    return cur.toDF("node", "component")


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return (r[0], r[1])
