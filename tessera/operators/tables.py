"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

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


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table of its own, without lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
