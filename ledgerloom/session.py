"""Session settings, the shared work folder and small plan helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "ledgerloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI, AQE with skew-join handling; everything else is left to the cluster."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_root: str | None = None


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder of the cluster.

    The cluster names that folder in spark.checkpoint.dir. Only a local session
    without it gets a temporary folder of its own; elsewhere executors would each
    write to a disk of their own, so that is an error.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _local_root = _local_root or tempfile.mkdtemp(prefix="ledgerloom-")
        root = _local_root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stage_path(
    df: DataFrame, name: str, cluster_by: list[str] | None = None, spread: str | None = None
) -> str:
    """Write df as a Parquet table in the shared folder; returns its path.

    cluster_by sorts the files for row-group pruning; spread is a column that
    shares a hot cluster value between tasks.
    """
    path = work_dir(df.sparkSession, name)
    if cluster_by:
        salt = [F.pmod(F.xxhash64(spread), F.lit(16))] if spread else []
        df = df.repartition(*cluster_by, *salt).sortWithinPartitions(*cluster_by)
    df.write.parquet(path)
    return path


def stage(df: DataFrame, name: str, **layout) -> DataFrame:
    """df written by stage_path and read back.

    Used where one result feeds several branches of a plan: the branches read
    the written table instead of computing the input again, and a lost executor
    costs only a re-read.
    """
    return df.sparkSession.read.schema(df.schema).parquet(stage_path(df, name, **layout))


def inline_table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A lookup table whose rows are all literals of this package, hence bounded."""
    return spark.createDataFrame(rows, schema)


def salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "left", salts: int = 16
) -> DataFrame:
    """Equi-join on keys of which one may hold a large share of the left rows.

    Each right row is repeated once per salt, each left row takes the salt of its
    `spread` value, so a hot key is shared by `salts` tasks. Left rows whose first
    key is NULL or empty match nothing and are spread without bound.
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(salts))
    first = F.col(keys[0]).cast("string")
    unmatched = F.coalesce(first == "", F.lit(True))
    left = left.withColumn("_salt", F.when(unmatched, F.xxhash64(spread)).otherwise(salt))
    right = right.where(F.col(keys[0]).cast("string") != "").withColumn(
        "_salt", F.explode(F.array(*[F.lit(s).cast("bigint") for s in range(salts)]))
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
