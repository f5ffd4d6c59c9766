"""The feature transforms: typed column functions with declared inputs and outputs.

A transform adds its outputs to a frame. Those made of windows add columns in stages, which
Catalyst merges into as few window nodes as their order allows; sequential ones are folds, and the
kit runs all folds of a request in one pass. Names: one input, one output gives
``{input}_{suffix}``; several inputs give the suffix alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import timedelta

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, series
from ..functions.series import Axis, div, ratio, safe_log
from ..operators.sequential import Fold, run_folds

REGISTRY: dict[str, type] = {}


def nanos(t: timedelta | float | int) -> int:
    """ns of a timedelta or of seconds."""
    return round((t.total_seconds() if isinstance(t, timedelta) else t) * 1e9)


def ref(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass
class Transform:
    """Base of all transforms; subclass, set requires and produces, and give ``columns`` or ``add``."""

    requires: list[str] = field(default_factory=list)
    produces: list[str] = field(default_factory=list)

    def __init_subclass__(cls) -> None:
        REGISTRY[cls.__name__] = cls

    def _set(self, inputs: str | list[str], outputs: str | list[str], **params: object) -> None:
        self.requires = [inputs] if isinstance(inputs, str) else list(inputs)
        outs = [outputs] if isinstance(outputs, str) else list(outputs)
        prefix = f"{inputs}_" if isinstance(inputs, str) and not isinstance(self, Identity) else ""
        self.produces = [prefix + o for o in outs]
        self.params = params

    @property
    def output_name(self) -> str | list[str]:
        return self.produces[0] if len(self.produces) == 1 else list(self.produces)

    def validate(self, columns: list[str]) -> None:
        if missing := [c for c in self.requires if c not in columns]:
            raise ValueError(f"{type(self).__name__}: missing columns {missing}")

    def columns(self, ax: Axis, *x: Column) -> Column | list[Column]:
        raise NotImplementedError

    def add(self, df: DataFrame, ax: Axis) -> DataFrame:
        self.validate(df.columns)
        got = self.columns(ax, *map(ref, self.requires))
        return df.withColumns(dict(zip(self.produces, got if isinstance(got, list) else [got], strict=True)))

    def __call__(self, df: DataFrame, ax: Axis | None = None, backend: str = "spark") -> DataFrame:
        if backend not in ("spark", "pd", "nb"):
            raise ValueError(f"unknown backend {backend}")
        return self.add(df, ax or Axis())

    def to_config(self) -> dict:
        enc = lambda v: {"__timedelta__": v.total_seconds()} if isinstance(v, timedelta) else v
        return {"op": type(self).__name__, "args": {k: enc(v) for k, v in self.params.items()}}


class Staged(Transform):
    """Adds named columns step by step and drops those that are not outputs."""

    def steps(self, ax: Axis) -> list[dict[str, Column]]:
        raise NotImplementedError

    def add(self, df: DataFrame, ax: Axis) -> DataFrame:
        self.validate(df.columns)
        temporary = []
        for step in self.steps(ax):
            df = df.withColumns(step)
            temporary += [c for c in step if c not in self.produces]
        return df.drop(*temporary)


class Sequential(Transform):
    """A fold over each symbol's rows."""

    #: whether the fold tells NaN from NULL
    nans = False

    def fold(self) -> Callable:
        raise NotImplementedError

    def as_fold(self, ax: Axis) -> Fold:
        return Fold(self.fold_inputs(ax), list(self.produces), self.fold(), nans=self.nans)

    def fold_inputs(self, ax: Axis) -> list[str]:
        return list(self.requires)

    def add(self, df: DataFrame, ax: Axis) -> DataFrame:
        self.validate(df.columns)
        return run_folds(df, [self.as_fold(ax)], ax.by, ax.order)


def simple(name: str, suffix: str, rule: Callable, needs: str | list[str] = "close", **defaults: object) -> type:
    """A transform class from a suffix pattern and a rule (axis, columns, parameters) -> column(s)."""
    several = isinstance(needs, list)
    key = "input_cols" if several else "input_col"

    def __init__(self, *args: object, **given: object) -> None:
        p = dict(zip(defaults, args, strict=False)) | given
        cols = p.pop(key, None) or needs
        for k, v in defaults.items():
            if p.setdefault(k, v) is ...:
                raise TypeError(f"{name}: {k} is needed")
        if extra := set(p) - set(defaults):
            raise TypeError(f"{name}: unknown {sorted(extra)}")
        out = suffix(p) if callable(suffix) else suffix.format(**p)
        self._set(cols, out, **p, **{key: cols})

    def columns(self, ax: Axis, *x: Column) -> Column:
        return rule(ax, *x, **{k: self.params[k] for k in defaults})

    return type(name, (Transform,), {"__init__": __init__, "columns": columns, "__doc__": rule.__doc__})


def _seconds(p: dict, key: str = "window") -> str:
    s = nanos(p[key]) / 1e9
    return "ret1" if s <= 1e-6 else f"ret{s:g}s"


def _vwap_distance(ax: Axis, close: Column, volume: Column, periods: int, is_log: bool) -> Column:
    pv, v = F.sum(close * volume).over(ax.rows(periods)), F.sum(volume).over(ax.rows(periods))
    r = div(close, div(pv, v))
    return F.when(ax.full(periods, close, volume), safe_log(r) if is_log else r - 1)


def _bar_rate(p: dict) -> str:
    s = nanos(p["window"]) / 1e9
    return "bars_per_hour" if s % 60 == 0 else f"rate_{s / 60:g}m"


Lag = simple("Lag", "lag{periods}", lambda ax, x, periods: ax.lag(x, periods), periods=1)
Return = simple("Return", "ret{periods}", lambda ax, x, periods, is_log: safe_log(div(x, ax.lag(x, periods))) if is_log else div(x, ax.lag(x, periods)) - 1, periods=1, is_log=False)
ReturnT = simple("ReturnT", _seconds, lambda ax, x, window, is_log: series.lagged_return(ax, x, F.struct(*map(ref, ax.order)), max(1, nanos(window)), is_log), window=1e-6, is_log=False)
ROC = simple("ROC", "roc{periods}", lambda ax, x, periods: 100 * div(x - ax.lag(x, periods), ax.lag(x, periods)), periods=...)
PctChange = simple("PctChange", "pctc{window}", lambda ax, x, window: F.when(ax.lag(x, window) > 0, (x - ax.lag(x, window)) / ax.lag(x, window)), window=...)
SMA = simple("SMA", "sma{window}", lambda ax, x, window: series.sma(ax, x, window), window=...)
RollingSum = simple("RollingSum", "rsum{window}", lambda ax, x, window: ax.agg(F.sum(x), window, x), window=...)
RollingStd = simple("RollingStd", "rstd{window}", lambda ax, x, window: series.rolling_std(ax, x, window), window=...)
ZScore = simple("ZScore", "z{window}", lambda ax, x, window, ddof: series.zscore(ax, x, window, ddof), window=..., ddof=0)
MeanReversionZScore = simple("MeanReversionZScore", "mr_z_{window}", lambda ax, x, window: series.zscore(ax, x, window, 1), window=48)
BollingerPercentB = simple("BollingerPercentB", "bollb{window}", lambda ax, x, window, num_std: series.bollinger_percent_b(ax, x, window, num_std), window=..., num_std=2.0)
BurstRatio = simple("BurstRatio", "burst{window}", lambda ax, x, window: series.burst_ratio(ax, x, window), window=...)
RealizedVolatility = simple("RealizedVolatility", "rv{window}", lambda ax, r, window, is_sample: series.realized_vol(ax, r, window, is_sample), "ret", window=..., is_sample=False)
KurtosisTransform = simple("KurtosisTransform", "kurt_{window}", lambda ax, x, window: ax.agg(F.kurtosis(x), window, x), "ret1", window=32)
VPIN = simple("VPIN", "vpin_{window}", lambda ax, b, s, window: series.vpin(ax, b, s, window), ["volume_buy", "volume_sell"], window=32)
FlowAcceleration = simple("FlowAcceleration", "flowacc_{window}_{recent_periods}", lambda ax, v, window, recent_periods: series.flow_acceleration(ax, v, window, recent_periods), "volume", window=..., recent_periods=...)
StochK = simple("StochK", "stochk{length}", lambda ax, h, l, c, length: series.stoch_k(ax, c, l, h, length), ["high", "low", "close"], length=14)
ParkinsonRange = simple("ParkinsonRange", "parkrange", lambda ax, h, l: series.parkinson_range(h, l), ["high", "low"])
BarRate = simple("BarRate", _bar_rate, lambda ax, x, window: F.count(F.lit(1)).over(ax.since(nanos(window))) * (3600e9 / nanos(window)), window=...)
BarDuration = simple("BarDuration", "dur_{periods}bar", lambda ax, x, periods: (ref(ax.time) - ax.lag(ref(ax.time), periods)) / 1e9, periods=1)


class Identity(Transform):
    """A column by name."""

    def __init__(self, input_col: str = "close") -> None:
        self._set(input_col, input_col, input_col=input_col)

    def add(self, df: DataFrame, ax: Axis) -> DataFrame:
        self.validate(df.columns)
        return df


class Arity(Transform):
    """Checks how many columns a transform takes and gives; the four subclasses are what a user's own transform derives from."""

    one_in = one_out = False

    def _set(self, inputs: str | list[str], outputs: str | list[str], **params: object) -> None:
        for what, names, one in (("input", inputs, self.one_in), ("output", outputs, self.one_out)):
            if isinstance(names, str) != one or (not one and not names):
                raise ValueError(f"{type(self).__name__} needs {'one' if one else 'a list of'} {what} name{'s' * (not one)}")
        super()._set(inputs, outputs, **params)

    def add(self, df: DataFrame, ax: Axis) -> DataFrame:
        self.validate(df.columns)
        got = self.columns(ax, *map(ref, self.requires))
        got = [got] if isinstance(got, Column) else list(got)
        if len(got) != len(self.produces):
            raise ValueError(f"{len(got)} results for {len(self.produces)} outputs")
        return df.withColumns(dict(zip(self.produces, got, strict=True)))


class SISO(Arity):
    """One column in, one out."""

    one_in = one_out = True


class MISO(Arity):
    """Several columns in, one out."""

    one_out = True


class SIMO(Arity):
    """One column in, several out."""

    one_in = True


class MIMO(Arity):
    """Several columns in, several out."""


class TimeCues(Transform):
    """Cyclical time of day and week and session flags."""

    NAMES = ["sin_td", "cos_td", "sin_dw", "cos_dw", "asia", "eu", "us", "sess_x", "top_hr"]

    def __init__(self, input_col: str = "close") -> None:
        self._set(input_col, self.NAMES, input_col=input_col)

    def columns(self, ax: Axis, x: Column) -> list[Column]:
        return list(series.time_cues(ref(ax.time)).values())


class CandleShape(Transform):
    """Wick and body ratios of the bar's range and the drift of VWAP from the open."""

    def __init__(self, input_cols: list[str] | None = None) -> None:
        cols = input_cols or ["open", "high", "low", "close", "vwap"]
        self._set(cols, ["wick_up_ratio", "wick_dn_ratio", "body_ratio", "vwap_drift"], input_cols=cols)

    def columns(self, ax: Axis, o: Column, h: Column, l: Column, c: Column, v: Column) -> list[Column]:
        span = h - l + 1e-12
        return [(h - F.greatest(o, c)) / span, (F.least(o, c) - l) / span, F.abs(c - o) / span, ratio(v - o, o)]


class VWAPDistance(Staged):
    """Close against the rolling VWAP; a window without volume repeats the last value."""

    def __init__(self, periods: int, is_log: bool = False, input_cols: list[str] | None = None) -> None:
        cols = input_cols or ["close", "volume"]
        self._set(cols, f"vwapd{periods}", periods=periods, is_log=is_log, input_cols=cols)

    def steps(self, ax: Axis) -> list[dict[str, Column]]:
        n, (c, v) = self.params["periods"], map(ref, self.requires)
        return [{"_d": _vwap_distance(ax, c, v, n, self.params["is_log"]), "_f": ax.full(n, c, v)}, {self.produces[0]: F.when(ref("_f"), F.last("_d", ignorenulls=True).over(ax.running))}]


class BiPowerVariation(Staged):
    """sqrt(pi/2) times the sum of products of neighbouring absolute returns."""

    def __init__(self, window: int = 12, input_col: str = "ret1") -> None:
        self._set(input_col, f"bv_{window}", window=window, input_col=input_col)

    def steps(self, ax: Axis) -> list[dict[str, Column]]:
        r = ref(self.requires[0])
        return [{"_p": ax.lag(r)}, {self.produces[0]: series.bipower(ax, r, ref("_p"), self.params["window"])}]


class PriceVolumeCorrelation(Staged):
    """Pearson correlation of the bar return and the volume over the pairs in the window."""

    def __init__(self, window: int = 8, input_cols: list[str] | None = None) -> None:
        cols = input_cols or ["close", "volume"]
        self._set(cols, f"corr_pv_{window}", window=window, input_cols=cols)

    def steps(self, ax: Axis) -> list[dict[str, Column]]:
        n, (c, v) = self.params["window"], map(ref, self.requires)
        r, v = F.when(v.isNotNull(), ref("_r")), F.when(ref("_r").isNotNull(), v)
        over = lambda f: f.over(ax.rows(n))
        value = div(over(F.covar_pop(r, v)), over(F.stddev_pop(r)) * over(F.stddev_pop(v)))
        value = F.greatest(F.least(value, F.lit(1.0)), F.lit(-1.0))
        return [{"_r": div(c, ax.lag(c)) - 1}, {self.produces[0]: F.when((F.count(F.lit(1)).over(ax.running) > n) & (ref("_r") + v).isNotNull(), value)}]


class VarianceRatio14(Staged):
    """Variance of one-bar returns over a fourth of that of overlapping four-bar sums."""

    def __init__(self, window: int = 32, input_col: str = "close", ret_type: str = "log", ddof: int = 0) -> None:
        self._set(input_col, f"var_ratio_1_4_{window}", window=window, input_col=input_col, ret_type=ret_type, ddof=ddof)

    def steps(self, ax: Axis) -> list[dict[str, Column]]:
        n, x = self.params["window"], ref(self.requires[0])
        r = div(x, ax.lag(x))
        var = lambda c: series.rolling_variance(ax, ref(c), n, self.params["ddof"])
        return [{"_r": safe_log(r) if self.params["ret_type"] == "log" else r - 1}, {"_r4": ax.agg(F.sum("_r"), 4, ref("_r"))}, {self.produces[0]: div(var("_r"), var("_r4") / 4)}]


class TrendSlope(Staged):
    """Angle in degrees of the least-squares slope of the log price."""

    def __init__(self, window: int = 24, input_col: str = "close") -> None:
        self._set(input_col, f"trend_slope_{window}", window=window, input_col=input_col)

    def steps(self, ax: Axis) -> list[dict[str, Column]]:
        x = ref(self.requires[0])
        return [{"_l": safe_log(x), "_i": F.row_number().over(ax.whole)}, {self.produces[0]: F.degrees(F.atan(ax.agg(F.regr_slope(ref("_l"), ref("_i")), self.params["window"], ref("_l"))))}]


class HurstExponent(Staged):
    """Slope of the log deviation of k-step differences of the running sum on log k, k = 1, 2, 4, 8."""

    def __init__(self, window: int = 24, input_col: str = "ret1") -> None:
        self._set(input_col, f"hurst{window}", window=window, input_col=input_col)

    def steps(self, ax: Axis) -> list[dict[str, Column]]:
        n, x = self.params["window"], ref(self.requires[0])
        if n <= 8:
            return [{self.produces[0]: F.lit(None).cast("double")}]
        ks = (1, 2, 4, 8)
        logs = [math.log(k) for k in ks]
        mean = sum(logs) / 4
        bottom = sum((a - mean) ** 2 for a in logs)
        sd = {f"_s{k}": F.stddev_pop(f"_d{k}").over(ax.rows(n - k)) for k in ks}
        top = sum(((a - mean) * F.log(ref(f"_s{k}")) for a, k in zip(logs, ks, strict=True)), F.lit(0.0))
        ok = ref("_f") & (ref("_s1") > 0) & (ref("_s2") > 0) & (ref("_s4") > 0) & (ref("_s8") > 0)
        return [{"_c": F.sum(x).over(ax.running), "_f": ax.full(n, x)}, {f"_d{k}": ref("_c") - ax.lag(ref("_c"), k) for k in ks}, sd, {self.produces[0]: F.when(ok, top / bottom)}]


class ATR(Staged):
    """Average true range: mean over the window, or Wilder's recursion; optionally over the mid price."""

    def __init__(self, window: int = 14, ema_based: bool = False, normalize: bool = False, input_cols: list[str] | None = None) -> None:
        cols = input_cols or ["high", "low", "close"]
        self._set(cols, f"atr{window}" + "_ema" * ema_based + "_norm" * normalize, window=window, ema_based=ema_based, normalize=normalize, input_cols=cols)

    def add(self, df: DataFrame, ax: Axis) -> DataFrame:
        self.validate(df.columns)
        n, (h, l, c) = self.params["window"], map(ref, self.requires)
        df = df.withColumn("_tr", series.true_range(h, l, ax.lag(c), F.row_number().over(ax.whole) == 1))
        if self.params["ema_based"]:
            df = run_folds(df, [Fold(["_tr"], ["_a"], lambda tr: kernels.wilder_mean(tr, n))], ax.by, ax.order)
        else:
            df = df.withColumn("_a", F.when(ax.full(n), F.avg("_tr").over(ax.rows(n))))
        return df.withColumn(self.produces[0], ratio(ref("_a"), (h + l) / 2) if self.params["normalize"] else ref("_a")).drop("_tr", "_a")


class DirRunLen(Staged):
    """Length of the current run of returns of one sign, infinite ones included; 0 at a zero, NaN or missing return."""

    def __init__(self, input_col: str = "ret1") -> None:
        self._set(input_col, "dir_run_len", input_col=input_col)

    def steps(self, ax: Axis) -> list[dict[str, Column]]:
        from pyspark.sql import Window

        sign = F.coalesce(F.nanvl(F.signum(ref(self.requires[0])), F.lit(0.0)), F.lit(0.0))
        run = F.row_number().over(Window.partitionBy(*ax.by, "_run").orderBy(*ax.order))
        return [{"_sg": sign}, {"_new": (ref("_sg") != F.coalesce(ax.lag(ref("_sg")), F.lit(9.0))).cast("int")}, {"_run": F.sum("_new").over(ax.running)}, {self.produces[0]: F.when(ref("_sg") == 0, 0).otherwise(run)}]


class DailyGap(Staged):
    """On the first bar of a UTC day: its value over the last value of the day before, less one."""

    def __init__(self, input_col: str = "close") -> None:
        self._set(input_col, "daily_gap", input_col=input_col)

    def steps(self, ax: Axis) -> list[dict[str, Column]]:
        x = ref(self.requires[0])
        day = F.call_function("div", ref(ax.time), F.lit(86_400_000_000_000))
        return [{"_day": day}, {"_pd": ax.lag(ref("_day")), "_px": ax.lag(x)}, {self.produces[0]: F.when(ref("_day") != ref("_pd"), ratio(x, ref("_px")) - 1)}]


class ORBBreak(Staged):
    """Closes beyond the range of a UTC day's first four bars; the day must start at 00:00 and have four bars."""

    def __init__(self, input_cols: list[str] | None = None) -> None:
        cols = input_cols or ["high", "low", "close"]
        self._set(cols, ["orb_long", "orb_short"], input_cols=cols)

    def steps(self, ax: Axis) -> list[dict[str, Column]]:
        from pyspark.sql import Window

        h, l, c = map(ref, self.requires)
        day = F.call_function("div", ref(ax.time), F.lit(86_400_000_000_000))
        whole = Window.partitionBy(*ax.by, "_day")
        early = ref("_k") <= 4
        ok = (ref("_n") >= 4) & (ref("_t0") % 86_400_000_000_000 == 0) & ~early
        return [
            {"_day": day},
            {"_k": F.row_number().over(whole.orderBy(*ax.order))},
            {"_n": F.count(F.lit(1)).over(whole), "_t0": F.min(ax.time).over(whole), "_hi": F.max(F.when(early, h)).over(whole), "_lo": F.min(F.when(early, l)).over(whole)},
            {"orb_long": F.coalesce(ok & (c > ref("_hi")), F.lit(False)).cast("int"), "orb_short": F.coalesce(ok & (c < ref("_lo")), F.lit(False)).cast("int")},
        ]


class EWMA(Sequential):
    """Adjusted exponential mean."""

    def __init__(self, span: int, input_col: str = "close") -> None:
        if span < 1:
            raise ValueError("span must be at least 1")
        self._set(input_col, f"ewma{span}", span=span, input_col=input_col)

    def fold(self) -> Callable:
        n = self.params["span"]
        return lambda y: kernels.ewma(y, n)


class EWMS(Sequential):
    """Adjusted exponential standard deviation."""

    def __init__(self, span: int, input_col: str = "close") -> None:
        self._set(input_col, f"ewmsd{span}", span=span, input_col=input_col)

    def fold(self) -> Callable:
        n = self.params["span"]
        return lambda y: kernels.ewms(y, n)


class EWMST(Sequential):
    """Exponential standard deviation with weights that decay in time; NaN after an infinity or NaN."""

    nans = True

    def __init__(self, half_life: timedelta | float, input_col: str = "y", mean0: bool = False) -> None:
        self._set(input_col, f"ewms{nanos(half_life) / 1e9:g}s", half_life=half_life, input_col=input_col, mean0=mean0)

    def fold_inputs(self, ax: Axis) -> list[str]:
        return [ax.time, *self.requires]

    def fold(self) -> Callable:
        ns, m0 = nanos(self.params["half_life"]), self.params["mean0"]
        return lambda t, y: kernels.ewmst(t, y, ns, mean0=m0)


class BarDurationEWMA(Sequential):
    """Exponential mean of the seconds between bars."""

    def __init__(self, span: int = 20, input_col: str = "close") -> None:
        self._set(input_col, f"dur_ewma{span}", span=span, input_col=input_col)

    def fold_inputs(self, ax: Axis) -> list[str]:
        return [ax.time]

    def fold(self) -> Callable:
        n = self.params["span"]
        return lambda t: kernels.ewma(np.append(np.nan, np.diff(t) / 1e9), n)


class RSIWilder(Sequential):
    """Wilder's relative strength index."""

    def __init__(self, window: int = 14, input_col: str = "close") -> None:
        self._set(input_col, f"rsiw{window}", window=window, input_col=input_col)

    def fold(self) -> Callable:
        n = self.params["window"]
        return lambda p: kernels.rsi_wilder(p, n)


class ADX(Sequential):
    """Average directional index."""

    def __init__(self, length: int = 14, input_cols: list[str] | None = None) -> None:
        cols = input_cols or ["high", "low", "close"]
        self._set(cols, f"adx_{length}", length=length, input_cols=cols)

    def fold(self) -> Callable:
        n = self.params["length"]
        return lambda h, l, c: kernels.adx(h, l, c, n)


class CUSUMTest(Sequential):
    """Structural-break scores, flags and ages of the Chu-Stinchcombe-White test, up and down."""

    def __init__(self, window_size: int = 50, warmup_period: int = 30, max_age: int = 144, input_col: str = "close") -> None:
        outs = [f"cumote_{side}{window_size}_{what}" for side in ("up", "down") for what in ("score", "flag", "age")]
        self._set(input_col, outs, window_size=window_size, warmup_period=warmup_period, max_age=max_age, input_col=input_col)

    def fold(self) -> Callable:
        p = self.params
        w, u, a = p["window_size"], p["warmup_period"], p["max_age"]
        return lambda y: kernels.cusum_scores(y, w, u, a)


class CUSUMDeveloping(Sequential):
    """The structural-break statistics over all rows so far with their critical values, up and down; NaN is told from NULL."""

    nans = True

    def __init__(self, warmup_period: int = 30, input_col: str = "close") -> None:
        outs = [f"cusum_{what}_{side}" for what in ("stat", "crit") for side in ("up", "down")]
        self._set(input_col, outs, warmup_period=warmup_period, input_col=input_col)

    def fold(self) -> Callable:
        n = self.params["warmup_period"]
        return lambda y: tuple(kernels.cusum_test_developing(y, n).T)


def cusum_last(df: DataFrame, price: str = "close", by: str = "symbol", order: str = "ts_ns") -> DataFrame:
    """(by, stat_up, stat_down, crit_up, crit_down): the expanding test at each series' last row."""
    import pandas as pd

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        got = kernels.cusum_test_last(pdf.sort_values(order)[price].to_numpy(float))
        return pd.DataFrame([(pdf[by].iloc[0], *(None if np.isnan(x) else float(x) for x in got))], columns=[by, "stat_up", "stat_down", "crit_up", "crit_down"])

    kind = df.schema[by].dataType.simpleString()
    return df.select(by, order, price).groupBy(by).applyInPandas(last, f"{by} {kind}, stat_up double, stat_down double, crit_up double, crit_down double")


class ApproximateEntropy(Sequential):
    """Approximate entropy of the trailing window."""

    def __init__(self, window: int = 24, m: int = 2, tolerance: float = 0.2, input_col: str = "ret1") -> None:
        self._set(input_col, f"apen{window}", window=window, m=m, tolerance=tolerance, input_col=input_col)

    def fold(self) -> Callable:
        n, m, t = (self.params[k] for k in ("window", "m", "tolerance"))
        return lambda x: kernels.rolling_apen(x, n, m, t)


class ExternalFunction(Sequential):
    """A callable, or its import path, over whole ordered columns of a symbol; one or several outputs."""

    def __init__(self, func: Callable | str, input_cols: str | list[str], output_cols: str | list[str] | None = None, args: list | None = None, kwargs: dict | None = None) -> None:
        name = func if isinstance(func, str) else f"{func.__module__}.{getattr(func, '__qualname__', getattr(func, '__name__', 'func'))}"
        outs = output_cols or f"ext_{name.rsplit('.', 1)[1]}"
        self._set(input_cols, outs, func=name, input_cols=input_cols, output_cols=output_cols, args=args or [], kwargs=kwargs or {})
        if output_cols:
            self.produces = [output_cols] if isinstance(output_cols, str) else list(output_cols)
        self.func = func

    def fold(self) -> Callable:
        func, args, kwargs = self.func, self.params["args"], self.params["kwargs"]

        def run(*x: np.ndarray) -> tuple | np.ndarray:
            f = func
            if isinstance(f, str):
                import importlib

                mod, _, attr = f.rpartition(".")
                f = getattr(importlib.import_module(mod), attr)
            return f(*x, *args, **kwargs)

        return run
