"""As-of and interval joins without nested loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, on: str = "ts_ns", by: str = "symbol", columns: list[str] | None = None, direction: str = "backward") -> DataFrame:
    """left with the columns of the right row last at or before (``forward``: first at or after) each left row.

    Both sides are laid into one, sorted once, and the payload is carried along; of right rows of
    equal time the last in payload order counts. One shuffle, linear.
    """
    columns = columns or [c for c in right.columns if c not in (on, by)]
    fields = [c for c in left.columns if c not in (on, by)]
    back = direction == "backward"
    payload = F.struct(*columns)
    l = left.select(by, on, F.lit(1 if back else 0).alias("_tag"), F.struct(*fields).alias("_l"), F.lit(None).cast(right.select(payload).schema[0].dataType).alias("_r"))
    r = right.select(by, on, F.lit(0 if back else 1).alias("_tag"), F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), payload.alias("_r"))
    w = Window.partitionBy(by).orderBy(on, "_tag", "_r")
    seen = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if back else F.first("_r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = l.unionByName(r).withColumn("_s", seen).where("_l IS NOT NULL")
    return out.select(by, on, "_l.*", *[F.col(f"_s.{c}").alias(c) for c in columns])


def interval(points: DataFrame, spans: DataFrame, width_ns: int, at: str = "ts_ns", start: str = "start_ns", by: str = "symbol") -> DataFrame:
    """Pairs with start <= at <= start + width, by equi-join on time buckets of ``width_ns``."""
    b = F.call_function("div", F.col(start), F.lit(width_ns))  # never by floating point
    return spans.withColumn("_b", F.explode(F.array(b, b + 1))).join(points.withColumn("_b", F.call_function("div", F.col(at), F.lit(width_ns))), [by, "_b"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(start) + width_ns)).drop("_b")
