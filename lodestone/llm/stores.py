"""Files in the shared folder, written and read by Python tasks, which have pyarrow's file systems but not Spark's.

The folder's scheme decides: local and mounted folders, and HDFS where its native library is installed on the executors, are used as
they are; for object stores pyarrow has other names than Hadoop (`SCHEMES`). What no name is known for is refused before a job begins.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from lodestone.llm.shared import new_dir

#: pyarrow's schemes for Hadoop's.
SCHEMES = {"": "file", "file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs", "abfs": "abfs", "abfss": "abfss"}


def open_store(uri: str) -> tuple[object, str]:
    """(pyarrow file system, path in it) of a folder or file named as Hadoop names it."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), uri
    if scheme not in SCHEMES:
        raise ValueError(f"tasks can't reach {scheme}: as a shared folder; known are {', '.join(filter(None, SCHEMES))}")
    if SCHEMES[scheme] == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{rest}")


def new_store(spark: SparkSession, what: str) -> str:
    """A new folder that tasks can write into; where they couldn't, a ValueError says so before any job."""
    where = new_dir(spark, what)
    try:
        store, path = open_store(where)
        store.create_dir(path, recursive=True)
    except (OSError, ValueError, NotImplementedError) as error:
        raise ValueError(f"spark.checkpoint.dir can't be written by Python tasks: {where}: {error}") from error
    return where
