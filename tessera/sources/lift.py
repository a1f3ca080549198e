"""The driver's relational tables as triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.dataset import Lifted, LiftedDataset
from tessera.terms import DATETIME, DOUBLE, INTEGER, STRING, Kind

NS = "http://ex.org/"
_KINDS = {"int": INTEGER, "bigint": INTEGER, "double": DOUBLE, "timestamp": DATETIME, "timestamp_ntz": DATETIME, "string": STRING}
#: table -> (class, key column, foreign key column -> (object property, table))
TABLES: dict[str, tuple[str, str | None, dict[str, tuple[str, str]]]] = {
    "region": ("Region", "r_regionkey", {}),
    "nation": ("Nation", "n_nationkey", {"n_regionkey": ("inRegion", "region")}),
    "customer": ("Customer", "c_custkey", {"c_nationkey": ("inNation", "nation")}),
    "supplier": ("Supplier", "s_suppkey", {"s_nationkey": ("inNation", "nation")}),
    "part": ("Part", "p_partkey", {}),
    "orders": ("Order", "o_orderkey", {"o_custkey": ("placedBy", "customer")}),
    "lineitem": ("LineItem", None, {"l_orderkey": ("ofOrder", "orders"), "l_partkey": ("ofPart", "part"), "l_suppkey": ("bySupplier", "supplier")}),
    "events": ("Event", "event_id", {"user_id": ("byUser", "customer")}),
}


def row_key(df: DataFrame) -> Column:
    """A line item's id: its ids alone aren't unique, its whole row is."""
    ids = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return F.concat_ws("-", *ids, F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns]), 256))


def lifted(df: DataFrame, table: str) -> Lifted:
    of_class, key, links = TABLES[table]
    columns: dict[str, tuple[str, Kind]] = {f"<{NS}{c}>": (c, _KINDS[t]) for c, t in df.dtypes if t in _KINDS}
    return Lifted(
        df,
        f"{NS}{table}/",
        F.col(key) if key else row_key(df),
        NS + of_class,
        columns,
        {f"<{NS}{p}>": (c, f"{NS}{to}/") for c, (p, to) in links.items()},
    )


def dataset(spark: SparkSession, sf_dir: str, tables: list[str] | None = None) -> LiftedDataset:
    return LiftedDataset(lifted(spark.read.parquet(f"{sf_dir}/{t}.parquet"), t) for t in tables or TABLES)
