"""Streaming twins: watermarked time bars and samplers with constant state per symbol.

Late trades beyond the watermark (one bar by default) are dropped. The input has an event-time
column ``ts`` (timestamp) beside the trades' columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.bars import ceil_to


def time_bars(stream: DataFrame, seconds: float, delay: str | None = None) -> DataFrame:
    """OHLCV of right-closed bars; bar_id is the close in ns. Append mode emits a bar when the watermark passes it."""
    step = round(seconds * 1e9)
    d = stream.withColumn("bar_id", ceil_to(F.col("ts_ns"), step)).withColumn("bar_end", F.timestamp_micros(F.expr("bar_id div 1000")))
    d = d.withWatermark("bar_end", delay or f"{seconds} seconds")
    key = F.struct("ts_ns", "id")
    v = F.sum("amount")
    return d.groupBy("symbol", "bar_id", "bar_end").agg(F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), v.alias("volume"), F.count(F.lit(1)).alias("trades"), F.try_divide(F.sum(F.col("price") * F.col("amount")), v).alias("vwap"))


def dedup(stream: DataFrame, delay: str = "1 minute") -> DataFrame:
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "id"])


CLOSES = "symbol string, ts_ns bigint, id bigint, price double, bar_id bigint"


def _sampler(stream: DataFrame, state: str, start: tuple, step) -> DataFrame:
    """Rows that close a bar. step(state, row) -> (state, closed); rows of a batch are taken in (ts_ns, id)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        s = held.get if held.exists else start
        pdf = pd.concat(list(batches)).sort_values(["ts_ns", "id"])
        out = []
        for row in pdf.itertuples(index=False):
            s, bar = step(s, row)
            if bar is not None:
                out.append((key[0], row.ts_ns, row.id, row.price, bar))
        held.update(s)
        yield pd.DataFrame(out, columns=["symbol", "ts_ns", "id", "price", "bar_id"])

    return stream.groupBy("symbol").applyInPandasWithState(run, CLOSES, state, "append", GroupStateTimeout.NoTimeout)


def tick_closes(stream: DataFrame, ticks: int) -> DataFrame:
    def step(s, row):
        n, bar = s
        n += 1
        return ((n, bar + 1), bar) if n >= 2 and n % ticks == 0 else ((n, bar), None)

    return _sampler(stream, "n bigint, bar bigint", (0, 0), step)


def volume_closes(stream: DataFrame, threshold: float) -> DataFrame:
    def step(s, row):
        n, total, bar = s
        total += row.amount
        return ((n + 1, 0.0, bar + 1), bar) if n and total >= threshold else ((n + 1, total, bar), None)

    return _sampler(stream, "n bigint, total double, bar bigint", (0, 0.0, 0), step)


def dollar_closes(stream: DataFrame, threshold: float) -> DataFrame:
    def step(s, row):
        n, total, bar = s
        total += row.amount * row.price
        return ((n + 1, total - threshold, bar + 1), bar) if n and total >= threshold else ((n + 1, total, bar), None)

    return _sampler(stream, "n bigint, total double, bar bigint", (0, 0.0, 0), step)


def cusum_events(stream: DataFrame, threshold: float) -> DataFrame:
    """The CUSUM event filter; bar_id counts the events."""

    def step(s, row):
        last, pos, neg, bar = s
        if last > 0 and row.price > 0:  # as in batch, a price that is not positive moves nothing
            r = math.log(row.price / last)
            pos, neg = max(0.0, pos + r), min(0.0, neg + r)
            if neg < -threshold:
                return (row.price, pos, 0.0, bar + 1), bar
            if pos > threshold:
                return (row.price, 0.0, neg, bar + 1), bar
        return (row.price, pos, neg, bar), None

    return _sampler(stream, "last double, pos double, neg double, bar bigint", (0.0, 0.0, 0.0, 0), step)


def ewm_mean(stream: DataFrame, span: float) -> DataFrame:
    """Adjusted exponential mean of prices at the last row of each batch; bar_id is the row count."""
    q = 1 - 2 / (span + 1)

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        u, v, n = held.get if held.exists else (0.0, 0.0, 0)
        pdf = pd.concat(list(batches)).sort_values(["ts_ns", "id"])
        for p in pdf["price"]:
            u, v, n = q * u + p, q * v + 1, n + 1
        held.update((u, v, n))
        yield pd.DataFrame([(key[0], int(pdf["ts_ns"].iloc[-1]), int(pdf["id"].iloc[-1]), u / v, n)], columns=["symbol", "ts_ns", "id", "price", "bar_id"])

    return stream.groupBy("symbol").applyInPandasWithState(run, CLOSES, "u double, v double, n bigint", "append", GroupStateTimeout.NoTimeout)
