"""An index kept up to date by a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.index import Index, manifest, manifest_diff


def latest(files: DataFrame) -> DataFrame:
    """The newest row of each path, by mtime_ms."""
    order = Window.partitionBy("path").orderBy(F.desc("mtime_ms"), F.desc("size"))
    return files.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def maintain(stream: DataFrame, index: Index, checkpoint: str) -> StreamingQuery:
    """Merges each micro-batch of (path, mtime_ms, size, content) into the index; rows of null size are deletions.

    A batch writes its own notes alone. One that comes again after a failure changes nothing: its rows are in the manifest already.
    """

    def fold(batch: DataFrame, _: int) -> None:
        now = latest(batch).persist()
        try:
            present = now.where("size is not null").select("path", "mtime_ms", "size", "content")
            if not index.ready():
                index.build(present)
                return
            # only the batch's paths are compared, so the rest of the index stays as it is
            known = index.table("manifest").join(now.select("path"), "path", "left_semi")
            index.apply(manifest_diff(known, manifest(present)), manifest(present), present)
        finally:
            now.unpersist()

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
