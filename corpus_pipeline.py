"""A corpus pipeline: language, near-duplicates, decontamination, mixing, shards. Each stage is written and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontamination, languages, mixing, neardup, sharding
from lodestone.llm.shared import new_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a learned language. Those without letters go, null and empty ones too, and those that fit no language: with trigrams enough to tell, by the
    model's floor; shorter ones, whose scores say little, only where no better than chance. Repeated rows and rows without doc_id stay or go by their text."""
    docs = docs.select(*COLUMNS)
    model = languages.fit(docs, F.lit(True))
    least = 1.1 / len(model.names) if len(model.names) > 1 else 0.0
    known = languages.identify(docs, model, foreign=True)
    return known.where((F.col("lang_pred") != "und") & (F.col("score") >= least) & ~F.col("foreign")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each near-duplicate group. Of repeated rows, and of a doc_id's several texts, one stays; of rows without
    doc_id those stay that are no copies. Null and word-less texts are no copies of each other."""
    return neardup.drop_near_duplicates(docs.select(*COLUMNS)).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. A hit document goes whole: what is left around a span of a test may still give its answer away. Rows without doc_id stay or go by
    their text like others; null and empty texts stay."""
    return decontamination.drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: repeated rows where a source is taken more than once, none where it isn't taken. Null texts have no words, the null source is a source, equal doc_ids
    are taken alike."""
    return mixing.taken(docs.select(*COLUMNS)).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of each document, its place within it, and its size. Repeated rows share a shard and have slots of their own; null doc_ids are one key, null texts are empty."""
    return sharding.op3_query(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: The language classifiers can't be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = new_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(out := f"{where}/{k}-{name}")
        docs = spark.read.parquet(out)
    return docs
