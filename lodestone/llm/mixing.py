"""Operator 10: mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

A source's target is met by whole passes over its documents plus a part of one pass: the documents whose hash lies below a
threshold. The threshold is found without sorting: tokens are summed by source and by the first 12 bits of the hash; the
bucket in which the running sum passes the budget is the boundary, and only its rows are summed again by the next 12 bits,
five times, until 60 bits are fixed. Sums and thresholds are tables, joined as sizes permit. The windows over sources see one row for each source, in one task: sources are taken to be
names, thousands at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import cut, sized

#: Documents fixed: the weights that sources get in the order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
LEVELS, BITS = 5, 12


def words(text: Column) -> Column:
    """The number of runs of characters other than space, tab, newline, vertical tab, form feed and carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash60(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, most: float = 3.0, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row for each source.

    Sources weigh by their place in code point order, null last. Targets share `share` of all sizes by weight; none is above
    `most` times its source's size, and what that leaves over is shared among the others by weight. That is one
    water level: the sources with the least size for their weight are full, the others get the level times their weight.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    w = F.array(*map(F.lit, weights))
    ranked = sources.withColumn("_w", F.get(w, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))))).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), F.asc_nulls_last("source"))
    everything = Window.partitionBy()
    levels = (
        ranked.withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_weight", F.sum("_w").over(everything))
        .withColumn("_full", F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_used", F.coalesce(F.sum("_w").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - F.col("_full")) / (F.col("_weight") - F.col("_used")))
    )
    level = F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))).over(everything)
    return levels.withColumn("_at", level).select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_at") * F.col("_w"), F.col("_cap"))).alias("target"))


def plan(rows: DataFrame, most: float, weights: tuple[float, ...], share: float) -> tuple[DataFrame, int]:
    """(_s, source_size, target, passes, _threshold), a row for each source, and how many there are, from (source, size, _hash)."""
    aims = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), most, weights, share)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    aims = cut(aims.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))
    n = aims.count()  # sources; thresholds have as many rows at most
    # the boundary so far: the bits fixed, and the budget that is left within them
    edge = aims.where("rest > 0 and source_size > 0").select(F.col("source").alias("_s"), F.lit(0).cast("long").alias("_prefix"), F.col("rest").alias("_left"))
    for level in range(1, LEVELS + 1):
        below = BITS * (LEVELS - level)
        inside = rows.join(sized(edge, n), F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("_hash", below + BITS) == F.col("_prefix"))) if level > 1 else rows.join(sized(edge, n), F.col("source").eqNullSafe(F.col("_s")))
        sums = inside.groupBy("_s", "_left", F.shiftright("_hash", below).alias("_prefix")).agg(F.sum("size").alias("_n"))
        running = Window.partitionBy("_s").orderBy("_prefix")
        sums = sums.withColumn("_upto", F.sum("_n").over(running.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_before", F.col("_upto") - F.col("_n"))
        if level < LEVELS:
            hit = sums.where("_upto > _left and _before <= _left")
            edge = cut(hit.select("_s", "_prefix", (F.col("_left") - F.col("_before")).alias("_left")))
        else:
            hit = sums.where("_upto > _left and _before <= _left")
            edge = cut(hit.select("_s", F.when(2 * F.col("_before") + F.col("_n") <= 2 * F.col("_left"), F.col("_prefix") + 1).otherwise(F.col("_prefix")).alias("_threshold")))
    aims = aims.join(edge, F.col("source").eqNullSafe(F.col("_s")), "left").select(F.col("source").alias("_s"), "source_size", "target", "passes", F.coalesce("_threshold", F.lit(0).cast("long")).alias("_threshold"))
    return cut(aims), n


def _rows(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    return cut(docs.select(F.col(key), F.col(source).alias("source"), words(F.col(text)).alias("size"), hash60(F.col(key)).alias("_hash")))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", most: float = 3.0, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0) -> DataFrame:
    """(key, source, size, source_size, target, times): how often the mix takes each document.

    Null texts have size 0, and documents of size 0 are taken as often as their source's whole passes. Documents with equal keys, null ones too,
    are taken or left together. Rows of the null source are a source. The last document is taken if at least half of it fits. An empty table gives none.
    """
    rows = _rows(docs, key, text, source)
    aims, n = plan(rows, most, weights, share)
    out = rows.join(sized(aims, n), F.col("source").eqNullSafe(F.col("_s")))
    return out.select(key, "source", "size", "source_size", "target", (F.col("passes") + (F.col("_hash") < F.col("_threshold")).cast("long")).alias("times"))


def taken(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", most: float = 3.0, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0) -> DataFrame:
    """docs as often as `mix` takes them: repeated rows, or none. How often follows from a row's source and key, so texts meet the few rows of the sources alone."""
    aims, n = plan(_rows(docs, key, text, source), most, weights, share)
    aims = aims.select(F.struct("_s", "passes", "_threshold").alias("_mixing"))
    times = F.col("_mixing.passes") + (hash60(F.col(key)) < F.col("_mixing._threshold")).cast("long")
    found = docs.join(sized(aims, n), F.col(source).eqNullSafe(F.col("_mixing._s")))
    return found.withColumn("_mixing", F.explode(F.when(times > 0, F.sequence(F.lit(1).cast("long"), times)))).drop("_mixing")


def op10_query(docs: DataFrame) -> DataFrame:
    """Sources by code point weigh 5, 2, 1, repeating, and share all sizes, none above 3 times its source's. Nulls, ties and repeats as in `mix`."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


OP10_SQL = r"""
WITH rows_ AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows_ GROUP BY 1),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 3.0::DOUBLE AS cap FROM s),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level FROM w
    WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT max(level) FROM v WHERE level * w <= cap) * w, cap)) AS target FROM v),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
r AS (SELECT rows_.*, source_size, target, passes, target - passes * source_size AS rest,
    sum(size) OVER (PARTITION BY rows_.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM rows_ JOIN p ON rows_.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(size * (passes + CASE WHEN rest > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
