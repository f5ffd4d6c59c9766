"""Session helpers: a tuned local session, and shipping the package to the executors' Python workers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers; once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="tickloom-ship-")) / "tickloom_package.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, f"{top.name}/{p.relative_to(top)}")
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new path that the driver and all executors share: under ``spark.checkpoint.dir``, or where that is unset a local one, in local mode alone."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tickloom-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:8]}"


def local_session(cpus: int = 8, partitions: int | None = None, memory: str = "8g", name: str = "tickloom") -> SparkSession:
    """A local session with the settings that the engine assumes: UTC, adaptive execution, Arrow."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
