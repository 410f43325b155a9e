"""Work folders that driver and executors share, and tables written there to be read several times."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder below `spark.checkpoint.dir`, or, in local mode where that is unset, a temporary one. It goes when the driver's Python ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        where = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
        sc = spark.sparkContext

        def drop() -> None:
            try:
                path = sc._jvm.org.apache.hadoop.fs.Path(where)
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
            except Exception:  # noqa: BLE001  the session may be gone; its end must not fail on cleaning up
                return

        atexit.register(drop)
        return where
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="lodestone-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    return f"file://{local}/{what}"


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """df written as a table and read back, so that queries that read it several times work it out once, by the columns they need."""
    where = work_dir(df.sparkSession, what)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
