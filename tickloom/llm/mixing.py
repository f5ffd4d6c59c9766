"""Mixing sources to target weights by capped water-filling. DataFrame functions only.

Sources share ``share`` of all words by their weights. A source's target stops at ``max_epochs``
times its size; the excess goes to the others in proportion to their weights until no target is
above its cap. That fixed point has a closed form: with the sources ordered by cap / weight, a
prefix of them is capped, and the rest share what is left. It is computed by windows over the
table of sources, one row each, from exact integers up to one last division.

A source's target is met by whole repetitions of all its documents and a seeded sample for the
fraction: documents in the order of a hash of seed and id, up to the fraction's words. The order
is never sorted as a whole: the hash's first three hex digits deal each source into 4096 buckets,
prefix sums of the buckets place each bucket, and only rows of one bucket are ordered, so a source
with a third of all rows is 4096 small groups.

Defined cases: null texts and texts without words have size 0 and are taken 0 times their size;
the null source is a source of its own, ordered last; a source of size 0 has target 0; rows with
equal id are ordered by size and may be drawn one without the other; an empty table gives no rows.
Weights are positive integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stage


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cyclic_weights(sizes: DataFrame, weights: list[int]) -> DataFrame:
    """(source, source_size, weight): the weights repeat over the sources by code point, null last."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long").alias("weight"))


def water_fill(sources: DataFrame, max_epochs: int, share: float = 1.0) -> DataFrame:
    """Adds ``target`` (double) to (source, source_size, weight)."""
    everything = W.partitionBy()
    by_ratio = W.orderBy((F.col("cap") / F.col("weight").cast("double")).asc(), F.col("source").asc_nulls_last())
    s = sources.withColumn("cap", F.col("source_size") * max_epochs)
    s = s.withColumn("total", F.sum("source_size").over(everything) if share == 1.0 else F.floor(F.sum("source_size").over(everything) * share).cast("long"))
    s = s.withColumns({"before": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "rest": F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))})
    s = s.withColumn("capped", F.col("cap") * F.col("rest") <= F.col("weight") * (F.col("total") - F.col("before")))
    s = s.withColumns({"used": F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0)), "open": F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything), F.lit(1))})
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("weight") * (F.col("total") - F.col("used"))).cast("double") / F.col("open").cast("double"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: list[int], max_epochs: int = 3, share: float = 1.0, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) and the columns ``keep``, a row per row of docs."""
    stage = Stage(docs.sparkSession, "mix")
    extra = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep or [])]
    rows = stage.put(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))).alias("h"), *extra), "rows")
    rows = rows.withColumn("bucket", F.substring("h", 1, 3))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = water_fill(cyclic_weights(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights), max_epochs, share)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.select(F.col("source").alias("_s"), "source_size", "target", whole.alias("whole"))
    before = F.coalesce(F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = buckets.withColumn("start", before).join(targets, F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "start", "source_size", "target", "whole")
    inside = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("h", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    out = rows.withColumn("inside", inside).join(placed, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    fraction = F.col("target") - (F.col("whole") * F.col("source_size")).cast("double")
    drawn = (2 * (F.col("start") + F.col("inside")) + F.col("size")).cast("double") <= 2 * fraction
    copies = F.col("whole") + F.when(drawn & (fraction > 0), 1).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep or [])])
