"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import ledgerloom.llm
from ledgerloom.session import work_dir

# functions of this package travel to the executors with the job; they need no copy of it on their path
cloudpickle.register_pickle_by_value(ledgerloom.llm)

#: Words are runs of anything but ASCII white space. bytes.split() splits at just these six bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch: with texts of a megabyte a batch stays under 64 MB.
BATCH_ROWS = 64
#: Parts that a key is shared by where it may hold a large share of the rows.
SALTS = 32


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; none for a null text."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def map_rows(df: DataFrame, each: Callable[..., Iterator[dict]], schema: str | StructType,
             finish: Callable | None = None, setup: Callable | None = None) -> DataFrame:
    """mapInArrow over rows as dicts; rows go through one at a time, so memory holds one batch.

    setup() makes a state once per task, given to each(row, state); finish(state) yields the last rows.
    """
    target = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        state = setup() if setup else None
        out: list[dict] = []
        for batch in batches:
            names = batch.schema.names
            columns = [c.to_pylist() for c in batch.columns]
            for values in zip(*columns):
                row = dict(zip(names, values))
                out.extend(each(row, state) if setup else each(row))
                if len(out) >= 4 * BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        if finish:
            out.extend(finish(state))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, target)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, so that very long texts don't fill a worker; a user's own smaller value stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder; what reads it is cut off from df's lineage."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], spread: str | Column, how: str = "inner",
             salts: int = SALTS) -> DataFrame:
    """Equi-join where one key may hold a large share of the left rows.

    Left rows of a key go to `salts` tasks by their `spread` value and right rows to all of them. Right keys are
    unique or few per key. Keys must not be null.
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    left = left.withColumn("__salt", salt)
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], spread: str | Column, how: str = "inner",
              share: int = 1024, salts: int = 64) -> DataFrame:
    """Equi-join that salts just the keys with more than a `share`-th of the left rows, of which there are fewer than that.

    left is read twice; right keys are unique or few per key, keys must not be null.
    """
    least = max(1000, left.count() // share)
    hot = left.groupBy(*keys).count().where(F.col("count") > least).select(*keys)
    hot = F.broadcast(hot.withColumn("__hot", F.lit(True)))  # fewer than `share` rows
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)
    last = F.when(F.col("__hot"), F.lit(salts - 1)).otherwise(0)
    left = left.join(hot, keys, "left").withColumn("__salt", salt).drop("__hot")
    right = right.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), last))).drop("__hot")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
