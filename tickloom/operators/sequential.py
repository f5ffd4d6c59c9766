"""Runs NumPy folds per symbol: all folds of a request in one grouped Arrow pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Fold:
    """fold(*inputs) gives an array, or one for each output.

    nans: inputs and results are masked arrays, where what is masked is NULL and NaN stays NaN;
    without it NaN is NULL.
    """

    inputs: list[str]
    outputs: list[str]
    run: Callable
    kind: str = "double"
    nans: bool = False


def run_folds(df: DataFrame, folds: list[Fold], by: list[str], order: list[str]) -> DataFrame:
    """df with the folds' outputs; one shuffle by symbol for all of them."""
    outs = [o for f in folds for o in f.outputs]
    keep = [c for c in df.columns if c not in outs]
    kinds = {o: f.kind for f in folds for o in f.outputs}
    nulls = {c: f"_null_{c}" for f in folds if f.nans for c in f.inputs if not c.endswith("_ns")}
    marks = {o: f"_nan_{o}" for f in folds if f.nans for o in f.outputs}
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"`{o}` {kinds[o]}" for o in outs] + [f"`{m}` boolean" for m in marks.values()])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        cols = {}
        for f in folds:
            x = [pdf[c].to_numpy(dtype=np.int64 if c.endswith("_ns") else float, na_value=np.nan) if not c.endswith("_ns") else pdf[c].to_numpy(np.int64) for c in f.inputs]
            if f.nans:
                x = [np.ma.masked_array(a, pdf[nulls[c]].to_numpy(bool)) if c in nulls else a for c, a in zip(f.inputs, x, strict=True)]
            got = f.run(*x)
            got = got if isinstance(got, tuple) else (got,)
            if len(got) != len(f.outputs):
                raise ValueError(f"{len(got)} results for {len(f.outputs)} outputs")
            for name, a in zip(f.outputs, got, strict=True):
                if f.nans:
                    cols[marks[name]] = pd.Series(np.isnan(np.ma.getdata(a)) & ~np.ma.getmaskarray(a))
                    a = np.ma.filled(a, np.nan)
                s = pd.Series(np.asarray(a))
                cols[name] = s.where(s.notna(), None) if f.kind == "double" else s
        return pd.concat([pdf[keep], pd.DataFrame(cols, index=pdf.index)], axis=1)

    out = df.select(*[f"`{c}`" for c in keep], *[F.col(f"`{c}`").isNull().alias(m) for c, m in nulls.items()]).groupBy(*by).applyInPandas(one, schema)
    nan = {o: F.when(F.col(f"`{m}`"), F.lit(float("nan"))) for o, m in marks.items()}
    told = lambda c: nan[c] if c in nan else F.when(F.isnan(f"`{c}`"), None)
    return out.select(*[F.col(f"`{c}`") if c not in kinds or kinds[c] != "double" else told(c).otherwise(F.col(f"`{c}`")).alias(c) for c in [*keep, *outs]])
