"""The folder that driver and executors share, checkpoints, and sizes behind which a side is broadcast."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a few numbers each up to which a join side is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset, a temporary folder, which only local mode may use."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(where)
        return where
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    where = tempfile.mkdtemp(prefix="lodestone-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    sc.setCheckpointDir(f"file://{where}")
    return f"file://{where}"


def schema_with(df: DataFrame, **more: T.DataType) -> T.StructType:
    """df's schema and further columns."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in more.items())])


def new_dir(spark: SparkSession, what: str) -> str:
    """A new folder below the shared one; it goes when the driver's Python ends."""
    where = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            remove(spark, where)
        except Exception:  # noqa: BLE001  the session may be gone; its end must not fail on what is only cleaning up
            return

    atexit.register(drop)
    return where


def cut(df: DataFrame) -> DataFrame:
    """df computed once and read back from the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, where: str) -> None:
    """Removes a folder of any store that Spark reaches."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read back. Unlike a checkpoint's, its size is the files', not a product of estimates: loops need that,
    or the planner's estimates grow by a power with each round until planning itself never ends."""
    where = new_dir(df.sparkSession, "table")
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df, of which `rows` is the known count, marked for broadcast if that is small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def range_buckets(df: DataFrame, key: str, rows_each: int = 2_000, least: int = 1, most: int = 4_096) -> tuple[Callable[[Column], Column], int]:
    """An expression that numbers ranges of `key` (a long) holding about `rows_each` rows each, ascending, nulls first; and their number.

    There are `most` ranges at most, which then hold more rows each.

    Only the key column is read. The bounds are approximate quantiles; any bounds give right results, these give even ones.
    """
    rows = df.where(F.col(key).isNotNull()).count()
    n = min(max(least, -(-rows // rows_each)), most)
    if n <= 1:
        return lambda c: F.lit(0), 1
    bounds = sorted(set(df.select(F.col(key).cast("long").alias(key)).approxQuantile(key, [i / n for i in range(1, n)], 0.2 / n)))
    if not bounds:
        return lambda c: F.lit(0), 1
    levels = [bounds[i : i + 64] for i in range(0, len(bounds), 64)]

    def bucket(c: Column) -> Column:
        inside = [F.size(F.filter(F.array(*map(F.lit, map(int, level))), lambda b: b <= c)) for level in levels]
        found = inside[-1] + F.lit(64 * (len(levels) - 1))
        for i in reversed(range(len(levels) - 1)):
            found = F.when(c < F.lit(int(levels[i + 1][0])), inside[i] + F.lit(64 * i)).otherwise(found)
        return F.when(c.isNull(), F.lit(0)).otherwise(found).cast("int")

    return bucket, len(bounds) + 1
