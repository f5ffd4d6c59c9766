"""Trades: the feed's schema, its preprocessing chain and its integrity report.

A feed is ``symbol, id, ts, price, amount`` and, if known, ``is_buyer_maker``; the trades table is
``symbol, seq, ts_ns, price, amount, side`` with seq counting each symbol's trades in (time, id).
All steps are windows over one (symbol, time, id) order, so one shuffle by symbol serves them.
"""

from __future__ import annotations

from functools import reduce
from math import floor, gcd, log10

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_NS = 86_400_000_000_000
#: ns in a unit
UNITS = {"s": 1_000_000_000, "ms": 1_000_000, "us": 1_000, "ns": 1}
FEED = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("id", T.LongType()), T.StructField("ts", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("amount", T.DoubleType()), T.StructField("is_buyer_maker", T.BooleanType())])


def by_symbol(*order: str | Column) -> Window:
    return Window.partitionBy("symbol").orderBy(*order)


def infer_unit(df: DataFrame, ts: str = "ts") -> str:
    """Unit of the epoch stamps from the largest: one aggregate."""
    top = df.agg(F.max(ts)).first()[0]
    return next((u for u, least in (("ns", 1e18), ("us", 1e15), ("ms", 1e12)) if top is not None and top > least), "s")


def to_ns(ts: Column, unit: str) -> Column:
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit}")
    return ts.cast("long") * UNITS[unit]


def sort_trades(df: DataFrame) -> DataFrame:
    """The earliest row of each id (of equal times the least price, then amount), with seq in (time, id)."""
    first = F.row_number().over(Window.partitionBy("symbol", "id").orderBy("ts_ns", "price", "amount")) == 1
    df = df.withColumn("_first", first).where("_first").drop("_first")
    return add_seq(df)


def chunk_of(ts_ns: Column) -> Column:
    """Day number: what ordered steps over trades are cut by, so that a symbol is many tasks."""
    return F.call_function("div", ts_ns, F.lit(CHUNK_NS))


def _with_days(d: DataFrame, days: DataFrame) -> DataFrame:
    """d (symbol, _c, ...) with the columns of its day's row; symbols and days that are NULL match too."""
    days = days.withColumnsRenamed({"symbol": "_symbol", "_c": "_day"})
    return d.join(days, d["symbol"].eqNullSafe(days["_symbol"]) & d["_c"].eqNullSafe(days["_day"])).drop("_symbol", "_day")


def add_seq(df: DataFrame) -> DataFrame:
    """seq counts each symbol's rows in (time, id), rows without a time last: rows are numbered within a day, on top of the counts of the days before."""
    d = df.withColumn("_c", chunk_of(F.col("ts_ns")))
    days = d.groupBy("symbol", "_c").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(by_symbol(F.asc_nulls_last("_c")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select("symbol", "_c", before.alias("_n"))
    at = F.row_number().over(Window.partitionBy("symbol", "_c").orderBy("ts_ns", "id"))
    return _with_days(d, days).withColumn("seq", F.col("_n") + at.cast("long") - 1).drop("_c", "_n")


def integrity(df: DataFrame, max_gap_ns: int = 60_000_000_000) -> DataFrame:
    """Missing id ranges with a time jump over ``max_gap_ns``."""
    w = by_symbol("id")
    g = df.select("symbol", F.lag("id").over(w).alias("start_id"), F.col("id").alias("end_id"), F.lag("ts_ns").over(w).alias("pre_gap_ns"), F.col("ts_ns").alias("post_gap_ns"))
    return g.where((F.col("end_id") - F.col("start_id") > 1) & (F.col("post_gap_ns") - F.col("pre_gap_ns") > max_gap_ns)).select("symbol", "start_id", "end_id", (F.col("end_id") - F.col("start_id") - 1).alias("missing_ids"), "pre_gap_ns", "post_gap_ns", (F.col("post_gap_ns") - F.col("pre_gap_ns")).alias("interval_ns"))


def missing_percent(df: DataFrame) -> DataFrame:
    gap = F.col("id") - F.lag("id").over(by_symbol("id")) - 1
    return df.select("symbol", gap.alias("gap")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), (F.sum(F.when(F.col("gap") > 0, F.col("gap")).otherwise(0)) / F.count(F.lit(1)) * 100).alias("missing_pct"))


def merge_split(df: DataFrame) -> DataFrame:
    """Collapse consecutive trades of equal time, price (1e-8) and, if known, side; amounts add up."""
    w = by_symbol("seq")
    new = F.lag("ts_ns").over(w).isNull() | (F.col("ts_ns") != F.lag("ts_ns").over(w)) | (F.abs(F.col("price") - F.lag("price").over(w)) >= 1e-8)
    known = "is_buyer_maker" in df.columns
    if known:
        new = new | (F.col("is_buyer_maker") != F.lag("is_buyer_maker").over(w))
    d = df.withColumn("_run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    side = [F.when(F.first("is_buyer_maker"), -1).otherwise(1).cast("tinyint").alias("side")] if known else []
    out = d.groupBy("symbol", "_run").agg(F.min("ts_ns").alias("ts_ns"), F.min_by("price", "seq").alias("price"), F.sum("amount").alias("amount"), F.min("id").alias("id"), *side)
    return out.withColumn("seq", F.col("_run").cast("long") - 1).drop("_run")


def round_time(ts_ns: Column, resolution: str) -> Column:
    return ts_ns - ts_ns % UNITS[resolution]


def _sign(d: Column) -> Column:
    return F.when(d > 1e-12, 1).when(d < -1e-12, -1)


def add_side(df: DataFrame) -> DataFrame:
    """Side by the tick rule, day by day: a day takes the last price and side of the days before from one row a day."""
    d = df.withColumn("_c", chunk_of(F.col("ts_ns")))
    w = Window.partitionBy("symbol", "_c").orderBy("seq")
    d = d.withColumns({"_d": _sign(F.col("price") - F.lag("price").over(w)), "_first": F.row_number().over(w) == 1})
    days = d.groupBy("symbol", "_c").agg(F.min_by("price", "seq").alias("a"), F.max_by("price", "seq").alias("z"), F.max_by("_d", F.when(F.col("_d").isNotNull(), F.col("seq"))).alias("tail"))
    by_day = by_symbol(F.asc_nulls_last("_c"))
    days = days.withColumn("_head", _sign(F.col("a") - F.lag("z").over(by_day)))
    days = days.withColumn("_before", F.last(F.coalesce("tail", "_head"), ignorenulls=True).over(by_day.rowsBetween(Window.unboundedPreceding, -1))).select("symbol", "_c", "_head", "_before")
    d = _with_days(d, days).withColumn("_d", F.when(F.col("_first"), F.col("_head")).otherwise(F.col("_d")))
    side = F.coalesce(F.last("_d", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("_before"), F.lit(0)).cast("tinyint")
    return d.withColumn("side", side).drop("_c", "_d", "_first", "_head", "_before")


def in_order(df: DataFrame, ts: str = "ts_ns", order: str = "seq") -> DataFrame:
    """(symbol, ordered): whether times never decrease."""
    back = F.col(ts) < F.lag(ts).over(by_symbol(order))
    return df.select("symbol", F.coalesce(back, F.lit(False)).alias("b")).groupBy("symbol").agg((F.max(F.col("b").cast("int")) == 0).alias("ordered"))


def check_types(df: DataFrame) -> None:
    """TypeError if a column of the feed is of another kind than FEED's: whole numbers, numbers, a boolean."""
    kinds = {"id": T.IntegralType, "ts": T.NumericType, "price": T.NumericType, "amount": T.NumericType, "is_buyer_maker": T.BooleanType}
    for c, kind in kinds.items():
        if c in df.columns and not isinstance(df.schema[c].dataType, kind):
            raise TypeError(f"column {c} is {df.schema[c].dataType.simpleString()}")


def preprocess(df: DataFrame, unit: str | None = None, resolution: str | None = None) -> DataFrame:
    """Feed to trades: unit, order and duplicates, merging, rounding, side."""
    for c in ("symbol", "id", "ts", "price", "amount"):
        if c not in df.columns:
            raise ValueError(f"the feed has no column {c}")
    check_types(df)
    d = df.withColumn("ts_ns", to_ns(F.col("ts"), unit or infer_unit(df))).drop("ts")
    d = merge_split(sort_trades(d))
    if resolution:
        d = d.withColumn("ts_ns", round_time(F.col("ts_ns"), resolution))
    if "side" not in d.columns:
        d = add_side(d)
    return d.select("symbol", "seq", "id", "ts_ns", F.timestamp_micros(F.expr("ts_ns div 1000")).alias("ts"), "price", "amount", "side")


def view(df: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Rows in the range, both ends included."""
    if start_ns >= end_ns:
        raise ValueError("start must be before end")
    return df.where(F.col("ts_ns").between(start_ns, end_ns))


def _steps(prices: list[float]) -> list[float]:
    return [b - a for a, b in zip(prices, prices[1:], strict=False)]


def common_step(steps: list[float]) -> float:
    """Greatest common step; 0 if there is none."""
    if not steps:
        return 0.0
    scale = 10.0 ** -floor(log10(min(steps)))
    return reduce(gcd, [round(s * scale) for s in steps]) / scale


def median_step(steps: list[float]) -> float:
    """Legacy estimate: median step, to two significant digits; a tie goes up, whatever the last bits of the difference."""
    if not steps:
        return 0.0
    s = sorted(steps)
    m = (s[len(s) // 2] + s[(len(s) - 1) // 2]) / 2
    scale = 10.0 ** (1 - floor(log10(m)))
    return floor(m * scale + 0.5 + 1e-9) / scale


def tick_sizes(df: DataFrame, most: int = 10_000) -> DataFrame:
    """(symbol, tick, legacy) from each symbol's first ``most`` prices, at 12 decimals.

    ``most`` is the estimate's own bound, so a symbol's prices are a short sorted array. A symbol of
    one price alone has no step and gives 0.
    """

    @F.pandas_udf("tick double, legacy double")
    def estimate(prices: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(common_step(s), median_step(s)) for s in (_steps(list(p)) for p in prices)], columns=["tick", "legacy"])

    held = df.where((F.col("seq") < most) & F.col("price").isNotNull()).groupBy("symbol").agg(F.array_sort(F.collect_set(F.round("price", 12))).alias("p"))
    return held.select("symbol", estimate("p").alias("e")).select("symbol", "e.*")


def tick_size(df: DataFrame, most: int = 10_000) -> float:
    """tick_sizes of a frame of one symbol; an error if it has no prices."""
    return _only(df, most).tick


def tick_size_median(df: DataFrame, most: int = 10_000) -> float:
    return _only(df, most).legacy


def _only(df: DataFrame, most: int) -> Row:
    rows = tick_sizes(df, most).take(2)
    if len(rows) != 1:
        raise ValueError("no prices" if not rows else "several symbols")
    return rows[0]


def median3(a: Column, b: Column, c: Column) -> Column:
    return F.element_at(F.array_sort(F.array(a, b, c)), 2)


def from_events(spark: SparkSession, sf_dir: str, single: bool = False) -> DataFrame:
    """The synthetic feed: a symbol per user of ``events`` (or one for all), without sides."""
    return as_trades(spark.read.parquet(f"{sf_dir}/events.parquet"), F.lit("ALL") if single else F.col("user_id").cast("string"))


def as_trades(events: DataFrame, symbol: Column) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(symbol.alias("symbol"), F.col("event_id").alias("id"), (micros * 1000).alias("ts_ns"), F.col("value").alias("price"), (F.get_json_object("props", "$.k").cast("double") + 1).alias("amount"))


def ordered_trades(spark: SparkSession, sf_dir: str, single: bool = False) -> DataFrame:
    """from_events with seq and the tick rule's side."""
    d = from_events(spark, sf_dir, single)
    return add_side(add_seq(d))
