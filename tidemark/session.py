"""A Spark session with the settings that the operators assume, and what several of them share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Estimated bytes of a join side that may be broadcast; beyond, Spark chooses.
BROADCAST_BYTES = 64 << 20


def session(name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return (b.master(master) if master else b).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def estimated(df: DataFrame) -> int:
    """The plan's estimated bytes; no job runs for it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits(df: DataFrame, factor: int = 1) -> bool:
    """Whether the plan's estimated size, times a factor for what the estimate leaves out, may be broadcast.

    No job runs for it. An explode multiplies rows and the estimate doesn't know by how much: hence the factor.
    """
    return estimated(df) * factor <= BROADCAST_BYTES


def small(df: DataFrame, factor: int = 1) -> DataFrame:
    """A broadcast hint if the frame fits; else the frame as it is."""
    return F.broadcast(df) if fits(df, factor) else df


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores if the scan has fewer parts than there are cores; else the frame as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_MADE: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors see; release() removes it."""
    _MADE.append(f"{_shared_root(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def _shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that isn't set, a local master gets a temporary folder and a cluster is refused."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf = "file://" + tempfile.gettempdir() + "/tidemark-shared"
    return conf.rstrip("/")


def made() -> tuple[str, ...]:
    """The folders that shared_dir has named and release hasn't removed."""
    return tuple(_MADE)


def release(spark: SparkSession, keep: tuple[str, ...] = ()) -> None:
    """Remove the folders made so far but those in `keep`; only once nothing that reads them is asked for."""
    for path in [p for p in _MADE if p not in keep]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _MADE.remove(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written to a fresh shared folder and read again: lineage is cut, and its size is known from its files."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder, in no more parts than a shuffle has; release() removes it."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(_shared_root(df.sparkSession))
    out = df.coalesce(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)).checkpoint()
    _MADE.append(out._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
    return out


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds running sums (this row's included) in a total order, without sorting the rows in one task.

    Rows are dealt to ranges of the order, once and for good (a checkpoint: range bounds are sampled);
    sums run within a range and start from what the ranges before hold, one row for each range.
    """
    rows = checkpointed(df.withColumns({f"_{n}": c for n, c in sums.items()}).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.groupBy(F.col("_range").alias("_at")).agg(*(F.sum(f"_{n}").alias(f"_{n}") for n in sums))
    held = held.select("_at", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums))
    out = rows.withColumns({n: F.sum(f"_{n}").over(inside) for n in sums}).join(F.broadcast(held), F.col("_range") == F.col("_at"))
    return out.select(*df.columns, *((F.col(n) + F.col(f"_before_{n}")).alias(n) for n in sums))
