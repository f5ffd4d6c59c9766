"""Footprints (volume by bar and price level), their features, and volume profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import value_area

LEVEL = "struct<level:int,buy_volume:double,sell_volume:double,buy_ticks:bigint,sell_ticks:bigint,buy_imbalance:boolean,sell_imbalance:boolean>"


def levels(bars: DataFrame, tick: float, imbalance_factor: float = 3.0) -> DataFrame:
    """A row per bar and level of the dense grid from low to high, with diagonal imbalances."""
    d = bars.withColumn("level", F.rint(F.col("price") / tick).cast("int"))
    part = lambda k, x: F.coalesce(F.sum(F.when(F.col("side") == k, x)), F.lit(0))
    at = d.groupBy("symbol", "bar_id", "level").agg(part(1, F.col("amount")).alias("buy_volume"), part(-1, F.col("amount")).alias("sell_volume"), part(1, F.lit(1)).alias("buy_ticks"), part(-1, F.lit(1)).alias("sell_ticks"))
    grid = at.groupBy("symbol", "bar_id").agg(F.min("level").alias("lo"), F.max("level").alias("hi")).select("symbol", "bar_id", F.explode(F.sequence("lo", "hi")).alias("level"))
    full = grid.join(at, ["symbol", "bar_id", "level"], "left").na.fill(0, ["buy_volume", "sell_volume", "buy_ticks", "sell_ticks"])
    w = Window.partitionBy("symbol", "bar_id").orderBy("level")
    above, below = F.lead("buy_volume").over(w), F.lag("sell_volume").over(w)
    return full.withColumns({"sell_imbalance": F.coalesce(F.col("sell_volume") > imbalance_factor * above, F.lit(False)), "buy_imbalance": F.coalesce(F.col("buy_volume") > imbalance_factor * below, F.lit(False))})


def footprints(bars: DataFrame, tick: float, imbalance_factor: float = 3.0) -> DataFrame:
    """A row per bar: the ordered levels and the features of the whole footprint."""
    d = levels(bars, tick, imbalance_factor)
    cell = F.struct("level", "buy_volume", "sell_volume", "buy_ticks", "sell_ticks", "buy_imbalance", "sell_imbalance")
    fp = d.groupBy("symbol", "bar_id").agg(F.array_sort(F.collect_list(cell)).alias("fp"))
    return with_features(fp)


def signed_run(fp: Column) -> Column:
    """Longest run of levels with one imbalance, signed; the first of equal runs counts."""
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        s = F.when(x["buy_imbalance"] & ~x["sell_imbalance"], 1).when(x["sell_imbalance"] & ~x["buy_imbalance"], -1).otherwise(0)
        run = F.when(s == 0, 0).when(F.signum(a["run"]) == s, a["run"] + s).otherwise(s)
        return F.struct(run.cast("int").alias("run"), F.when(F.abs(run) > F.abs(a["best"]), run).otherwise(a["best"]).cast("int").alias("best"))

    return F.aggregate(fp, zero, step, lambda a: a["best"])


def with_features(df: DataFrame, fp: str = "fp") -> DataFrame:
    """Imbalance counts and run, level of most volume (cot), skew and Gini-like share of the levels."""
    f = F.col(fp)
    total = F.aggregate(f, F.lit(0.0), lambda a, x: a + x["buy_volume"] + x["sell_volume"])
    top = F.array_max(F.transform(f, lambda x: F.struct((x["buy_volume"] + x["sell_volume"]).alias("v"), (-x["level"]).alias("l"))))
    count = lambda name: F.size(F.filter(f, lambda x: x[name]))
    df = df.withColumns({"n_buy_imbalance": count("buy_imbalance"), "n_sell_imbalance": count("sell_imbalance"), "imbalance_run": signed_run(f), "cot_level": -top["l"], "_t": total})
    mid = F.aggregate(f, F.lit(0.0), lambda a, x: a + (x["buy_volume"] + x["sell_volume"]) * x["level"])
    mean = F.try_divide(mid, F.col("_t"))
    square = F.aggregate(f, F.lit(0.0), lambda a, x: a + F.pow(x["buy_volume"] + x["sell_volume"], 2.0))
    df = df.withColumn("_m", mean)
    var = F.try_divide(F.aggregate(f, F.lit(0.0), lambda a, x: a + (x["buy_volume"] + x["sell_volume"]) * F.pow(x["level"] - F.col("_m"), 2.0)), F.col("_t"))
    third = F.try_divide(F.aggregate(f, F.lit(0.0), lambda a, x: a + (x["buy_volume"] + x["sell_volume"]) * F.pow(x["level"] - F.col("_m"), 3.0)), F.col("_t"))
    return df.withColumns({"vp_skew": F.when(var > 0, third / F.pow(var, 1.5)).otherwise(0.0), "vp_gini": F.when(F.col("_t") > 0, 1 - square / F.pow("_t", 2.0)).otherwise(0.0)}).drop("_t", "_m")


def unnest(df: DataFrame, tick: float) -> DataFrame:
    """Long form, time ascending and price descending within a bar."""
    return df.select("symbol", "bar_id", F.inline("fp")).withColumn("price_level", F.col("level") * tick).orderBy("symbol", "bar_id", F.desc("level"))


def between(df: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    return df.where(F.col("bar_id").between(start_ns, end_ns))


def is_valid(fp: Column) -> Column:
    """Levels ascend one by one."""
    return F.forall(F.transform(fp, lambda x, i: x["level"] - F.element_at(fp, 1)["level"] == i), lambda x: x)


def _cells(fp: DataFrame) -> DataFrame:
    return fp.select("symbol", "bar_id", F.inline("fp")).select("symbol", "bar_id", "level", (F.col("buy_volume") + F.col("sell_volume")).alias("volume"))


def _totals(bars: DataFrame, spans: DataFrame, steps: DataFrame, bucket_ns: int) -> DataFrame:
    """(symbol, bar_id, level, volume): the running sum of a level's steps at each bar of its spans.

    spans: (symbol, level, start, stop), both ends included; steps: (symbol, level, bar_id, turn, d),
    where turn 0 counts at its own bar and turn 2 after it. Bars meet spans by time buckets; a level
    is one running sum, so a symbol is as many tasks as it has levels, and no row is made beyond the
    bars and levels that come out.
    """
    bucket = lambda c: F.call_function("div", F.col(c), F.lit(bucket_ns))
    where = spans.withColumn("b", F.explode(F.sequence(bucket("start"), bucket("stop"))))
    at = bars.select("symbol", "bar_id").withColumn("b", bucket("bar_id")).join(where, ["symbol", "b"]).where("bar_id BETWEEN start AND stop")
    both = at.select("symbol", "level", "bar_id", F.lit(1).alias("turn"), F.lit(0.0).alias("d")).unionByName(steps)
    total = F.sum("d").over(Window.partitionBy("symbol", "level").orderBy("bar_id", "turn").rowsBetween(Window.unboundedPreceding, 0))
    return both.select("symbol", "bar_id", "level", "turn", F.round(total, 9).alias("volume")).where("turn = 1").drop("turn")


def window_levels(fp: DataFrame, seconds: float) -> DataFrame:
    """(symbol, bar_id, level, volume): levels summed over the bars of [t - W, t], by a difference array.

    A level enters with its bar and leaves after W; levels of no bar in the window have no row. Sums
    are rounded to 9 decimals, so that what has left leaves nothing behind.
    """
    step = round(seconds * 1e9)
    cells = _cells(fp)
    order = Window.partitionBy("symbol", "level").orderBy("bar_id")
    fresh = F.coalesce((F.col("bar_id") - F.lag("bar_id").over(order) > step).cast("int"), F.lit(1))
    run = F.sum("_f").over(order.rowsBetween(Window.unboundedPreceding, 0))
    spans = cells.withColumn("_f", fresh).withColumn("_r", run).groupBy("symbol", "level", "_r").agg(F.min("bar_id").alias("start"), (F.max("bar_id") + step).alias("stop")).drop("_r")
    enter = cells.select("symbol", "level", "bar_id", F.lit(0).alias("turn"), F.col("volume").alias("d"))
    leave = cells.select("symbol", "level", (F.col("bar_id") + step).alias("bar_id"), F.lit(2).alias("turn"), (-F.col("volume")).alias("d"))
    return _totals(fp, spans, enter.unionByName(leave), step)


def bucket_levels(df: DataFrame, n_bins: int) -> DataFrame:
    """Levels to bins of an odd width; integer midpoints, and a bin of its own at the last edge."""
    w = Window.partitionBy("symbol", "bar_id")
    d = df.withColumns({"_lo": F.min("level").over(w), "_hi": F.max("level").over(w)})
    width = F.greatest(F.lit(1), F.floor((F.col("_hi") - F.col("_lo")) / n_bins))
    d = d.withColumn("_w", (width + F.when(width % 2 == 0, 1).otherwise(0)).cast("int"))
    d = d.withColumn("_b", F.floor((F.col("level") - F.col("_lo")) / F.col("_w")).cast("int"))
    edge = F.ceil((F.col("_hi") + F.col("_w") - F.col("_lo")) / F.col("_w")) - 1  # bins between edges
    start = F.col("_lo") + F.col("_b") * F.col("_w")
    mid = F.when(F.col("_b") >= edge, F.col("_hi")).otherwise(F.floor((2 * start + F.col("_w") - 1) / 2))
    return d.groupBy("symbol", "bar_id", mid.cast("int").alias("level")).agg(F.sum("volume").alias("volume"))


def poc_area(df: DataFrame, percent: float = 68.34) -> DataFrame:
    """Point of control and value area of each bar's binned profile; pct_above is the share of volume above it."""
    packed = df.groupBy("symbol", "bar_id").agg(F.array_sort(F.collect_list(F.struct("level", "volume"))).alias("p"))

    @F.pandas_udf("poc int, hva int, lva int, pct_above double")
    def area(profiles: pd.Series) -> pd.DataFrame:
        rows = []
        for p in profiles:
            level, volume = np.array([x["level"] for x in p]), np.array([x["volume"] for x in p], float)
            poc, lo, hi = value_area(volume, percent)
            total = volume.sum()
            rows.append((level[poc], level[hi], level[lo], float(volume[poc + 1 :].sum() / total) if total else 0.0))
        return pd.DataFrame(rows, columns=["poc", "hva", "lva", "pct_above"])

    return packed.select("symbol", "bar_id", area("p").alias("a")).select("symbol", "bar_id", "a.*")


def profile_rolling(fp: DataFrame, seconds: float, n_bins: int = 27, percent: float = 68.34) -> DataFrame:
    """poc_area of the trailing window of every bar from the first that is a window after the start."""
    step = round(seconds * 1e9)
    warm = F.min("bar_id").over(Window.partitionBy("symbol")) + step
    ok = fp.select("symbol", "bar_id", warm.alias("_w")).where("bar_id >= _w").select("symbol", "bar_id")
    return poc_area(bucket_levels(window_levels(fp, seconds).join(ok, ["symbol", "bar_id"], "left_semi"), n_bins), percent)


def profile_range(fp: DataFrame, seconds: float, start_ns: int, end_ns: int, n_bins: int = 27, percent: float = 68.34) -> DataFrame:
    """profile_rolling of [start, end], with one window of warm-up before."""
    out = profile_rolling(between(fp, start_ns - round(seconds * 1e9), end_ns), seconds, n_bins, percent)
    return between(out, start_ns, end_ns)


def profile_developing(fp: DataFrame, start_ns: int, end_ns: int, n_bins: int = 27, percent: float = 68.34) -> DataFrame:
    """poc_area of the levels accumulated from the start of the session to each bar."""
    f = between(fp, start_ns, end_ns)
    cells = _cells(f)
    spans = cells.groupBy("symbol", "level").agg(F.min("bar_id").alias("start")).withColumn("stop", F.lit(end_ns))
    steps = cells.select("symbol", "level", "bar_id", F.lit(0).alias("turn"), F.col("volume").alias("d"))
    return poc_area(bucket_levels(_totals(f, spans, steps, max(1, (end_ns - start_ns) // 64)), n_bins), percent)


def trim_zeros(df: DataFrame) -> DataFrame:
    """Drop a bar's levels before the first and after the last with volume (8 decimals)."""
    w = Window.partitionBy("symbol", "bar_id")
    some = F.when(F.round("volume", 8) != 0, F.col("level"))
    return df.withColumns({"_a": F.min(some).over(w), "_b": F.max(some).over(w)}).where("level BETWEEN _a AND _b").drop("_a", "_b")
