"""Trade archives: CSV in ZIP scans, checksums, months, market names, and the monthly download."""

from __future__ import annotations

import io
import re
import urllib.error
import urllib.request
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..log import get_logger

COLUMNS = ["id", "price", "qty", "quoteQty", "time", "isBuyerMaker", "isBestMatch"]
MARKETS = {"spot": "spot", "um": "futures/um", "cm": "futures/cm"}
SCHEMA = "path string, id long, price double, amount double, ts long, is_buyer_maker boolean"


def truthy(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string"))).isin("1", "true", "t", "yes")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless trade CSVs by position; cells that do not parse are NULL."""
    raw = spark.read.schema(", ".join(f"{c} string" for c in COLUMNS)).csv(path, header=False)
    num = lambda c, t: F.expr(f"try_cast({c} AS {t})")
    return raw.select(num("id", "bigint").alias("id"), num("price", "double").alias("price"), num("qty", "double").alias("amount"), num("time", "bigint").alias("ts"), truthy(F.col("isBuyerMaker")).alias("is_buyer_maker")).where("id IS NOT NULL")


def read_zip(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The first CSV of each ZIP of a path, glob or list of paths, in parts of 200,000 rows; one task a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                z = zipfile.ZipFile(io.BytesIO(content))
                member = next(n for n in z.namelist() if n.lower().endswith(".csv"))
                for part in pd.read_csv(z.open(member), header=None, names=COLUMNS, dtype=str, chunksize=200_000):
                    n = lambda c: pd.to_numeric(part[c], errors="coerce")  # noqa: B023, E731
                    out = pd.DataFrame({"path": name, "id": n("id"), "price": n("price"), "amount": n("qty"), "ts": n("time"), "is_buyer_maker": part["isBuyerMaker"].str.strip().str.lower().isin(["1", "true", "t", "yes"])})
                    yield out.dropna(subset=["id"]).astype({"id": "int64", "ts": "int64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def checksum_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, sum) from the checksum files that lie beside the archives, named like them with ``.CHECKSUM``; none is no error."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.CHECKSUM")
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    if found is None or not len(found):
        return spark.createDataFrame([], "path string, sum string")
    d = spark.read.format("binaryFile").load(f"{path}.CHECKSUM")
    return d.select(F.regexp_replace("path", r"\.CHECKSUM$", "").alias("path"), F.col("content").cast("string").alias("sum"))


def verify_checksums(spark: SparkSession, path: str, sums: DataFrame | None = None) -> DataFrame:
    """(path, sha256, md5, ok): sha256 first, then md5; a file without a known sum is accepted.

    sums: (path, sum); by default those of the checksum files beside the archives.
    """
    d = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))
    want = F.lower(F.regexp_extract("sum", r"[0-9a-fA-F]{32,64}", 0))
    sums = checksum_files(spark, path) if sums is None else sums
    return d.join(sums.withColumn("sum", want), "path", "left").withColumn("ok", F.col("sum").isNull() | (F.col("sum") == F.col("sha256")) | (F.col("sum") == F.col("md5"))).drop("sum")


def months(start: str, end: str) -> list[str]:
    """'YYYY-MM' from start to end, both included; end may be 'now'."""
    parse = lambda s: pd.Period.now("M") if s == "now" else pd.Period(s, "M")
    if not all(s == "now" or re.fullmatch(r"\d{4}-\d{2}", s) for s in (start, end)):
        raise ValueError("months are YYYY-MM")
    return [str(p) for p in pd.period_range(parse(start), parse(end), freq="M")]


def market_path(market: str) -> str:
    m = market.lower().strip()
    m = {"futures": "um", "usdm": "um", "coinm": "cm"}.get(m, m)
    if m not in MARKETS:
        raise ValueError(f"unknown market {market}")
    return MARKETS[m]


def parse_store_name(name: str) -> tuple[str, str, str, str] | None:
    """(symbol, market, first, last) of SYMBOL_MARKET_YYMM-YYMM."""
    m = re.fullmatch(r"([A-Z0-9]+)_(\w+)_(\d{2})(\d{2})-(\d{2})(\d{2})(?:\.\w+)?", name)
    return (m[1], m[2], f"20{m[3]}-{m[4]}", f"20{m[5]}-{m[6]}") if m else None


def store_name(symbol: str, market: str, first: str, last: str) -> str:
    return f"{symbol}_{market}_{first[2:4]}{first[5:7]}-{last[2:4]}{last[5:7]}"


def find_store(folder: str, symbol: str, market: str) -> str | None:
    """Path of the symbol's store in a folder; of several the one that reaches furthest."""
    found = [(parsed[3], parsed[2], str(p)) for p in Path(folder).iterdir() if (parsed := parse_store_name(p.name)) and parsed[:2] == (symbol, market)]
    return max(found)[2] if found else None


def extend_name(path: str, first: str, last: str) -> str:
    """Rename a store so that its name covers these months too; its new path."""
    at = Path(path)
    symbol, market, a, b = parse_store_name(at.name)
    to = at.with_name(store_name(symbol, market, min(a, first), max(b, last)))
    return str(at.rename(to)) if to != at else path


def archive_urls(base: str, symbol: str, market: str, start: str, end: str) -> list[str]:
    return [f"{base.rstrip('/')}/{market_path(market)}/monthly/trades/{symbol}/{symbol}-trades-{m}.zip" for m in months(start, end)]


def download(url: str, folder: str, tries: int = 3) -> str | None:
    """Fetch a file once; None if the server has none."""
    to = Path(folder) / url.rsplit("/", 1)[1]
    for k in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=60) as r, open(f"{to}.part", "wb") as out:
                while block := r.read(1 << 20):
                    out.write(block)
            Path(f"{to}.part").rename(to)
            return str(to)
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            if k == tries - 1:
                raise
        except OSError:
            if k == tries - 1:
                raise
    return None


def ingest(spark: SparkSession, base: str, symbol: str, market: str, start: str, end: str, folder: str, store: str) -> dict[str, bool]:
    """Download months with their checksum files, preprocess the sound ones in one job, save them and their one-second bars.

    For each month found: whether its checksum held. Months that the server does not have are left out.
    """
    from .store import TradeStore
    from .trades import infer_unit, integrity, preprocess, sort_trades, to_ns

    urls = dict(zip(months(start, end), archive_urls(base, symbol, market, start, end), strict=True))
    found = {m: p for m, u in urls.items() if (p := download(u, folder))}
    for m in found:
        download(f"{urls[m]}.CHECKSUM", folder)
    ok = {m: bool(verify_checksums(spark, p).first().ok) for m, p in found.items()}
    for m in (m for m, good in ok.items() if not good):
        get_logger(__name__).warning("%s: the checksum does not hold, the month is left out", found[m])
    sound = [p for m, p in found.items() if ok[m]]
    if sound:
        feed = read_zip(spark, sound).withColumn("symbol", F.lit(symbol))
        s = TradeStore(spark, store)
        s.save(preprocess(feed.drop("path")), integrity_table=integrity(sort_trades(feed.withColumn("ts_ns", to_ns(F.col("ts"), infer_unit(feed))))))
        s.add_time_bars()
    return ok
