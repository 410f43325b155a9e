"""Bounded samples of labelled rows for fitting classifiers; whole texts, the same rows at every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample(rows: DataFrame, label: str, most: int, key: str = "doc_id") -> DataFrame:
    """(key, label) of about `most` rows shared equally among the labels, those with the least hash of their key.

    rows has only the key and label columns in use, so no text is read. The number of rows is most in expectation and
    within a few standard deviations of it; labels are expected to be few.
    """
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows.select(key, label).limit(0)
    each = max(20, most // len(counts))
    share = F.lit(0.0)
    for value, n in sorted(counts.items(), key=str):
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, each / n))).otherwise(share)
    h = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.select(key, label).where(h < share)
