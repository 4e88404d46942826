"""Session settings and lineage cutting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "hydrospark", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs assume; cluster settings stay with the caller."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    settings.update(conf)
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; where it is unset, one in the warehouse."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_runs"
        sc.setCheckpointDir(named)
    return named


#: A table with more rows is never sent to the driver and from there to every executor.
BROADCAST_ROWS = 100_000


def spread(df: DataFrame) -> DataFrame:
    """The rows, never broadcast by the planner's own choice; an explicit ``F.broadcast`` still holds.

    Spark takes exploded rows for as large as the file they come from, and a written table for as large as its
    compressed files. Either can be a hundred times larger in memory, and a broadcast passes through the driver.
    Adaptive execution keeps such a broadcast, as the right join costs more shuffles.
    """
    return df.hint("merge")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows in enough tasks for all cores, before heavy work on each row or many rows made of it.

    Scans are split by bytes, so a small file of many rows is one task, and rows exploded in it stay there. Rows lie by
    the keys given (a join or window by them needs no further shuffle), by default by all columns.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *(keys or df.columns))


def cut(df: DataFrame) -> DataFrame:
    """End the lineage with a table written to the shared folder and read back.

    The files survive lost executors. A written table rather than ``checkpoint()`` because the
    latter hands the predicates known of its source on to the next plan: in a loop they multiply
    round by round until planning dominates. The folder belongs to the run and can go with it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    # the count reads file footers only
    return spread(out) if out.count() > BROADCAST_ROWS else out
