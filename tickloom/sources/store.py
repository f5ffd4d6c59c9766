"""The trade store: Parquet partitioned by symbol and month, with metadata and integrity tables.

Months are written anew by dynamic partition overwrite; a time range is read through a month
predicate (partition pruning) and a time predicate (row-group statistics).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..operators.bars import fill_empty, ohlcv, resample, time_bars


def month_of(ns: Column) -> Column:
    return F.date_format(F.timestamp_micros(F.call_function("div", ns, F.lit(1000))), "yyyy-MM")


MONTHS = "symbol string, month string"
GAPS = "start_id long, end_id long, missing_ids long, pre_gap_ns long, post_gap_ns long, interval_ns long, symbol string, month string"


class TradeStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        try:
            found = self.spark.read.parquet(f"{self.path}/{name}").schema
        except AnalysisException as e:
            raise KeyError(name) from e
        # partition values are strings as written: a symbol of digits is no number
        kinds = T.StructType([T.StructField(f.name, T.StringType()) if f.name in ("symbol", "month") else f for f in found])
        return self.spark.read.schema(kinds).parquet(f"{self.path}/{name}")

    def _gaps(self) -> DataFrame:
        """The integrity table; empty while no gap was ever saved."""
        try:
            return self._read("integrity")
        except KeyError:
            return self.spark.createDataFrame([], GAPS)

    def _write(self, df: DataFrame, name: str, overwrite: bool = True) -> None:
        df.write.mode("overwrite" if overwrite else "append").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "month").parquet(f"{self.path}/{name}")

    def save(self, trades: DataFrame, overwrite_month: bool = True, integrity_table: DataFrame | None = None) -> None:
        """Write trades by month and the metadata of these months alone; the other months' rows and flags stay.

        A month is sound unless ``integrity_table`` has a gap that ends in it; a month that is added
        to (``overwrite_month`` false) stays unsound if it was.
        """
        d = trades.withColumn("month", month_of(F.col("ts_ns")))
        written = self.spark.createDataFrame(d.select("symbol", "month").distinct().collect(), MONTHS)  # a row a month: catalog size
        self._write(d.repartition("symbol", "month").sortWithinPartitions("symbol", "month", "ts_ns", "seq"), "trades", overwrite_month)
        bad = self.spark.createDataFrame([], MONTHS)
        if integrity_table is not None:
            found = integrity_table.withColumn("month", month_of(F.col("post_gap_ns")))
            self._write(found.join(F.broadcast(written), ["symbol", "month"], "left_semi"), "integrity", overwrite_month)
            bad = found.select("symbol", "month")
        if not overwrite_month:
            try:
                before = self._read("meta").where("NOT data_integrity_ok").select("symbol", "month").collect()
            except KeyError:
                before = []
            bad = bad.unionByName(self.spark.createDataFrame(before, MONTHS))
        meta = self._read("trades").join(F.broadcast(written), ["symbol", "month"], "left_semi").groupBy("symbol", "month").agg(F.count(F.lit(1)).alias("record_count"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), (F.lit(100.0) * (F.max("id") - F.min("id") + 1 - F.count_distinct("id")) / F.count(F.lit(1))).alias("missing_pct"))
        flags = bad.distinct().withColumn("_bad", F.lit(True))
        self._write(meta.join(flags, ["symbol", "month"], "left").withColumn("data_integrity_ok", F.col("_bad").isNull()).drop("_bad"), "meta")

    def months(self) -> DataFrame:
        return self._read("meta").select("symbol", "month").orderBy("symbol", "month")

    def metadata(self, symbol: str | None = None, month: str | None = None) -> DataFrame:
        """A row a month; KeyError if the symbol or month has none."""
        m = self._read("meta")
        for c, v in (("symbol", symbol), ("month", month)):
            m = m if v is None else m.where(F.col(c) == v)
        if not m.limit(1).count():
            raise KeyError((symbol, month))
        return m

    def integrity(self, symbol: str | None = None, month: str | None = None) -> DataFrame:
        """Gaps of the months that are not sound; rows of a month that was written anew and is sound do not count."""
        d = self._gaps().join(self._read("meta").where("NOT data_integrity_ok").select("symbol", "month"), ["symbol", "month"], "left_semi")
        for c, v in (("symbol", symbol), ("month", month)):
            d = d if v is None else d.where(F.col(c) == v)
        return d

    def integrity_summary(self) -> DataFrame:
        """Months that are not sound, with their metadata and gaps."""
        return self._read("meta").where("NOT data_integrity_ok").join(self._gaps(), ["symbol", "month"], "left")

    def mean_missing_percent(self) -> float | None:
        """Mean missing percentage over the months that are not sound; None if all are."""
        return self._read("meta").where("NOT data_integrity_ok").agg(F.avg("missing_pct")).first()[0]

    def statistics(self) -> DataFrame:
        return statistics(self._read("trades"))

    def gaps(self, max_gap_ns: int = 60_000_000_000) -> DataFrame:
        return gaps(self._read("trades"), max_gap_ns)

    def load(self, symbol: str | None = None, start_ns: int | None = None, end_ns: int | None = None, month: str | None = None, table: str = "trades", time: str = "ts_ns", ordered: bool = False) -> DataFrame:
        """Rows of a month, a range (both ends included) or both; KeyError if no month matches. ``ordered`` sorts them by symbol and time."""
        d, m = self._read(table), self._read("meta")
        if symbol is not None:
            d, m = d.where(F.col("symbol") == symbol), m.where(F.col("symbol") == symbol)
        if month is not None:
            d, m = d.where(F.col("month") == month), m.where(F.col("month") == month)
        if start_ns is not None:
            d, m = d.where((F.col(time) >= start_ns) & (F.col("month") >= month_of(F.lit(start_ns)))), m.where(F.col("last_ns") >= start_ns)
        if end_ns is not None:
            d, m = d.where((F.col(time) <= end_ns) & (F.col("month") <= month_of(F.lit(end_ns)))), m.where(F.col("first_ns") <= end_ns)
        if not m.limit(1).count():
            raise KeyError("no month matches")
        return d.orderBy("symbol", time) if ordered else d

    def add_time_bars(self, seconds: float = 1.0, overwrite: bool = False) -> DataFrame:
        """Time bars of the months that have none (all with overwrite); the months written."""
        todo = self._read("meta").select("symbol", "month")
        if not overwrite:
            try:
                todo = todo.join(self._read("klines").select("symbol", "month").distinct(), ["symbol", "month"], "left_anti")
            except KeyError:
                pass
        todo = self.spark.createDataFrame(todo.collect(), "symbol string, month string")  # a row a month: catalog size
        t = self._read("trades").join(todo, ["symbol", "month"], "left_semi")
        bars = fill_empty(ohlcv(time_bars(t, seconds)), t, seconds).withColumn("month", month_of(F.col("bar_id")))
        self._write(bars, "klines")
        return todo

    def bar_keys(self) -> DataFrame:
        """(symbol, month, bars, first_ns, last_ns) of the stored bars: a row a month."""
        return self._read("klines").groupBy("symbol", "month").agg(F.count(F.lit(1)).alias("bars"), F.min("bar_id").alias("first_ns"), F.max("bar_id").alias("last_ns"))

    def bar_range(self, symbol: str | None = None) -> tuple[int, int]:
        """First and last close over all stored bars, or those of a symbol; KeyError if there are none."""
        d = self._read("klines")
        first, last = (d if symbol is None else d.where(F.col("symbol") == symbol)).agg(F.min("bar_id"), F.max("bar_id")).first()
        if first is None:
            raise KeyError(symbol)
        return first, last

    def read_bars(self, symbol: str, start_ns: int | None = None, end_ns: int | None = None, seconds: float | None = None) -> DataFrame:
        """Stored bars of a range, resampled to ``seconds``; an end at midnight means that whole day, and of bars of whole days the one of the end is left out."""
        day = 86_400_000_000_000
        midnight = end_ns if end_ns is not None and end_ns % day == 0 else None
        if midnight is not None:
            end_ns += day - 1
        d = self._read("klines").where(F.col("symbol") == symbol)
        if start_ns is not None:
            d = d.where((F.col("bar_id") >= start_ns) & (F.col("month") >= month_of(F.lit(start_ns))))
        if end_ns is not None:
            d = d.where((F.col("bar_id") <= end_ns) & (F.col("month") <= month_of(F.lit(end_ns))))
        if seconds is None:
            return d
        d = resample(d, seconds)
        return d.where(F.col("bar_id") < midnight) if midnight is not None and round(seconds * 1e9) % day == 0 else d


def statistics(trades: DataFrame) -> DataFrame:
    """Count and ranges by symbol and month."""
    d = trades if "month" in trades.columns else trades.withColumn("month", month_of(F.col("ts_ns")))
    return d.groupBy("symbol", "month").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for c in ("ts_ns", "price", "amount") for n, f in (("min", F.min), ("max", F.max))])


def gaps(trades: DataFrame, max_gap_ns: int) -> DataFrame:
    """(symbol, month, ts_ns, gap_ns): rows more than max_gap_ns after the one before in their month."""
    d = trades if "month" in trades.columns else trades.withColumn("month", month_of(F.col("ts_ns")))
    gap = F.col("ts_ns") - F.lag("ts_ns").over(Window.partitionBy("symbol", "month").orderBy("ts_ns"))
    return d.select("symbol", "month", "ts_ns", gap.alias("gap_ns")).where(F.col("gap_ns") > max_gap_ns)
