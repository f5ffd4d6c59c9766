"""Bar samplers (trades -> bar_id) and bar aggregations.

Samplers add ``bar_id`` and drop trades that belong to no bar; positions are never materialised.
Aggregations are grouped by (symbol, bar_id) with map-side combination.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from .sequential import Fold, run_folds


def _by(*order: str) -> Window:
    return Window.partitionBy("symbol").orderBy(*order)


def ceil_to(ts: Column, step: int) -> Column:
    return ts + F.pmod(-ts, F.lit(step))


def time_bars(df: DataFrame, seconds: float) -> DataFrame:
    """Right-closed, left-open buckets of the epoch grid, labelled by their close; bar_id is the close in ns."""
    step = round(seconds * 1e9)
    starts = df.groupBy("symbol").agg(F.min("ts_ns").alias("_a")).select(F.col("symbol").alias("_symbol"), (F.col("_a") - F.pmod("_a", F.lit(step))).alias("_c0"))  # a row a symbol
    d = df.withColumn("bar_id", ceil_to(F.col("ts_ns"), step))
    d = d.join(starts, d["symbol"].eqNullSafe(starts["_symbol"]))
    return d.where("bar_id <> _c0").drop("_symbol", "_c0").withColumn("bar_ts", F.col("bar_id"))


def tick_bars(df: DataFrame, ticks: int) -> DataFrame:
    """Closed form: row i >= 1 closes when (i + 1) mod ticks = 0; the open tail is dropped."""
    ends = df.groupBy("symbol").agg((F.max("seq") + 1).alias("_n"))  # a row a symbol
    d = df.where("seq >= 1").withColumn("bar_id", F.floor(F.col("seq") / ticks).cast("long") if ticks > 1 else F.col("seq") - 1)
    return d.join(ends, "symbol").where((F.col("bar_id") + 1) * max(ticks, 1) <= F.col("_n") if ticks > 1 else F.lit(True)).drop("_n")


def _from_closes(df: DataFrame, close: str, first: str | None = None) -> DataFrame:
    """bar_id of rows after the sentinel, from flags of closing rows."""
    before = F.coalesce(F.sum(F.col(close).cast("long")).over(_by("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(F.col(close).cast("long")).over(Window.partitionBy("symbol"))
    d = df.withColumns({"bar_id": before, "_total": total})
    start = F.col("seq") >= 1 if first is None else F.col("seq") > F.col(first)
    return d.where(start & (F.col("bar_id") < F.col("_total"))).drop("_total", close, *([first] if first else []))


def volume_bars(df: DataFrame, threshold: float) -> DataFrame:
    """Close at the threshold; the overshoot is discarded. A sequential fold per symbol."""
    return _from_closes(run_folds(df, [Fold(["amount"], ["_close"], lambda v: kernels.volume_closes(v, threshold), "boolean")], ["symbol"], ["seq"]), "_close")


def dollar_bars(df: DataFrame, threshold: float) -> DataFrame:
    """Close at the threshold, the rest carried over. A sequential fold per symbol, as where a sum meets the threshold depends on the carry's last bits."""
    return _from_closes(run_folds(df, [Fold(["price", "amount"], ["_close"], lambda p, a: kernels.dollar_closes(p * a, threshold), "boolean")], ["symbol"], ["seq"]), "_close")


def cusum_bars(df: DataFrame, sigma: str = "sigma", sigma_floor: float = 5e-4, sigma_mult: float = 2.0) -> DataFrame:
    """Close when the CUSUM of log returns reaches max(mult * sigma, floor)."""
    import numpy as np

    # one run of the kernel: rows up to the first known sigma are -1, the others 1 where they close
    def run(ts: np.ndarray, p: np.ndarray, s: np.ndarray) -> np.ndarray:
        closes, first = kernels.cusum_closes(ts, p, s, sigma_floor, sigma_mult)
        return np.where(np.arange(len(p)) <= first, -1, closes.astype(np.int64))

    d = run_folds(df, [Fold(["ts_ns", "price", sigma], ["_state"], run, "bigint")], ["symbol"], ["seq"])
    d = d.withColumns({"_close": F.col("_state") == 1, "_first": F.sum((F.col("_state") < 0).cast("long")).over(Window.partitionBy("symbol")) - 1}).drop("_state")
    return _from_closes(d, "_close", "_first")


def cusum_sigma(bars: DataFrame, sigma: str = "sigma") -> DataFrame:
    """Sigma at each bar's close."""
    return bars.groupBy("symbol", "bar_id").agg(F.max_by(sigma, "seq").alias("sigma"))


def imbalance_bars(df: DataFrame, *args: object) -> DataFrame:
    raise NotImplementedError("imbalance bars")


def run_bars(df: DataFrame, *args: object) -> DataFrame:
    raise NotImplementedError("run bars")


class BarBuilder:
    """Extension point: give ``assign``; boundaries are computed once and shared by all aggregations."""

    def __init__(self, trades: DataFrame) -> None:
        self.trades, self._bars = trades, None

    def assign(self, trades: DataFrame) -> DataFrame:
        raise NotImplementedError

    @property
    def bars(self) -> DataFrame:
        if self._bars is None:
            self._bars = self.assign(self.trades)
        return self._bars

    def close_rows(self) -> DataFrame:
        return self.bars.groupBy("symbol", "bar_id").agg(F.max("seq").alias("close_seq"), F.max("ts_ns").alias("close_ns"))

    def build_ohlcv(self) -> DataFrame:
        return ohlcv(self.bars)

    def build_directional_features(self) -> DataFrame:
        return directional(self.trades, self.bars)

    def build_trade_size_features(self, theta: DataFrame | Column, theta_mult: float = 5.0) -> DataFrame:
        return trade_size(self.bars, theta, theta_mult)

    def build_footprints(self, tick: float, imbalance_factor: float = 3.0) -> DataFrame:
        from .footprint import footprints

        return footprints(self.bars, tick, imbalance_factor)


class TimeBars(BarBuilder):
    def __init__(self, trades: DataFrame, seconds: float, fill_empty: bool = True) -> None:
        super().__init__(trades)
        self.seconds, self.fill = seconds, fill_empty

    def assign(self, trades: DataFrame) -> DataFrame:
        return time_bars(trades, self.seconds)

    def build_ohlcv(self) -> DataFrame:
        bars = ohlcv(self.bars)
        return fill_empty(bars, self.trades, self.seconds) if self.fill else bars


def _builder(name: str, sampler) -> type:
    def __init__(self, trades: DataFrame, *args: object, **kwargs: object) -> None:
        BarBuilder.__init__(self, trades)
        self._args, self._kwargs = args, kwargs

    return type(name, (BarBuilder,), {"__init__": __init__, "assign": lambda self, t: sampler(t, *self._args, **self._kwargs), "__doc__": sampler.__doc__})


TickBars, VolumeBars, DollarBars, CUSUMBars = (_builder(n, f) for n, f in (("TickBars", tick_bars), ("VolumeBars", volume_bars), ("DollarBars", dollar_bars), ("CUSUMBars", cusum_bars)))


def ohlcv(bars: DataFrame) -> DataFrame:
    """Open, high, low, close, volume, vwap, trades and the exact median trade size of each bar."""
    v = F.sum("amount")
    return bars.groupBy("symbol", "bar_id").agg(
        F.max("ts_ns").alias("last_ns"),
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        v.alias("volume"),
        F.when(v > 0, F.sum(F.col("price") * F.col("amount")) / v).otherwise(0.0).alias("vwap"),
        F.count(F.lit(1)).alias("trades"),
        F.percentile("amount", F.lit(0.5)).alias("median_trade_size"),
    )


def fill_empty(bars: DataFrame, trades: DataFrame, seconds: float) -> DataFrame:
    """Time bars on a dense calendar: an empty bar repeats the last close; one more always follows the last."""
    step = round(seconds * 1e9)
    ends = trades.groupBy("symbol").agg(F.min("ts_ns").alias("a"), F.max("ts_ns").alias("b"), F.min_by("price", "seq").alias("p0"))
    first = F.col("a") - F.pmod(F.col("a"), F.lit(step)) + step
    clock = ends.select("symbol", "p0", F.explode(F.sequence(first, ceil_to(F.col("b"), step) + step, F.lit(step))).alias("bar_id"))
    d = clock.join(bars.drop("last_ns"), ["symbol", "bar_id"], "left")
    last = F.coalesce(F.last("close", ignorenulls=True).over(_by("bar_id").rowsBetween(Window.unboundedPreceding, 0)), F.col("p0"))
    d = d.withColumn("_l", last)
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("volume", "vwap", "median_trade_size")}
    return d.withColumns({c: F.coalesce(c, "_l") for c in ("open", "high", "low", "close")} | zero | {"trades": F.coalesce("trades", F.lit(0))}).drop("_l", "p0")


def directional(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Ticks, volume and dollars by side, spread at side flips, extremes of running signed sums.

    The side and price before a bar's first trade are those of the trade before it in the feed,
    except that a bar of one trade begins without a side.
    """
    prev = trades.select("symbol", "seq", F.lag("side").over(_by("seq")).alias("_ps"), F.lag("price").over(_by("seq")).alias("_pp"))
    s = F.col("side").cast("int")
    d = bars.join(prev, ["symbol", "seq"]).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol", "bar_id")))
    run = Window.partitionBy("symbol", "bar_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    flip = s != F.when(F.col("_n") == 1, 0).otherwise(F.coalesce("_ps", s))
    dollars = F.col("price") * F.col("amount")
    d = d.withColumns({"_spread": F.when(flip, F.abs(F.col("price") - F.col("_pp"))), "_ct": F.when(s != 0, F.sum(s).over(run)), "_cv": F.when(s != 0, F.sum(s * F.col("amount")).over(run)), "_cd": F.when(s != 0, F.sum(s * dollars).over(run))})
    side = lambda k, x: F.coalesce(F.sum(F.when(s == k, x)), F.lit(0))
    one, ticks = F.lit(1), F.sum(F.when(s != 0, 1))
    return d.groupBy("symbol", "bar_id").agg(
        side(1, one).alias("ticks_buy"), side(-1, one).alias("ticks_sell"),
        side(1, F.col("amount")).alias("volume_buy"), side(-1, F.col("amount")).alias("volume_sell"),
        side(1, dollars).alias("dollars_buy"), side(-1, dollars).alias("dollars_sell"),
        F.try_divide(F.coalesce(F.sum("_spread"), F.lit(0.0)), ticks.cast("double")).alias("mean_spread"), F.coalesce(F.max("_spread"), F.lit(0.0)).alias("max_spread"),
        F.min("_ct").alias("cum_ticks_min"), F.max("_ct").alias("cum_ticks_max"),
        F.min("_cv").alias("cum_volumes_min"), F.max("_cv").alias("cum_volumes_max"),
        F.min("_cd").alias("cum_dollars_min"), F.max("_cd").alias("cum_dollars_max"),
    )


def trade_size(bars: DataFrame, theta: DataFrame | float, theta_mult: float = 5.0) -> DataFrame:
    """Trade sizes against theta * mult. theta: a number, or (symbol, bar_id, theta)."""
    d = bars.join(theta, ["symbol", "bar_id"], "left") if isinstance(theta, DataFrame) else bars.withColumn("theta", F.lit(float(theta)))
    d = d.withColumn("_t", F.when(F.col("theta") > 0, F.col("theta") * theta_mult))
    a, v = F.col("amount"), F.sum("amount")
    ok = lambda x: F.when(F.max("_t").isNotNull(), x)
    return d.groupBy("symbol", "bar_id").agg(
        F.log1p(F.try_divide(F.avg("amount"), F.max("_t"))).alias("mean_size_rel"),
        F.log1p(F.try_divide(F.percentile("amount", F.lit(0.95)), F.max("_t"))).alias("size_95_rel"),
        ok(F.try_divide(F.sum(F.when(a > F.col("_t"), a).otherwise(0.0)), v)).alias("pct_block"),
        ok(F.when(F.count(F.lit(1)) == 1, 0.0).otherwise(1 - F.try_divide(F.sum(a * a), v * v))).alias("size_gini"),
    )


def resample(bars: DataFrame, seconds: float, align: str = "open") -> DataFrame:
    """Coarser bars from close-stamped fine ones. ``open`` floors the stamps; ``close`` keeps right-closed buckets."""
    step = round(seconds * 1e9)
    at = F.col("bar_id") - F.pmod(F.col("bar_id"), F.lit(step)) if align == "open" else ceil_to(F.col("bar_id"), step)
    d = bars.withColumns({"_b": at, "_k": F.col("bar_id")})
    w = Window.partitionBy("symbol", "_b")
    cum = F.sum("trades").over(w.orderBy("median_trade_size", "_k").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumns({"_cum": cum, "_all": F.sum("trades").over(w)})
    v = F.sum("volume")
    out = d.groupBy("symbol", "_b").agg(F.min_by("open", "_k").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "_k").alias("close"), v.alias("volume"), F.sum("trades").alias("trades"), F.when(v > 0, F.sum(F.col("vwap") * F.col("volume")) / v).alias("vwap"), F.min(F.when(2 * F.col("_cum") >= F.col("_all"), F.col("median_trade_size"))).alias("median_trade_size"))
    return out.withColumnRenamed("_b", "bar_id").where("open IS NOT NULL")
