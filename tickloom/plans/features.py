"""Lazy feature expressions, composition, the feature kit, its dependency graph and JSON configs.

Expressions are a small tree over transforms; the kit evaluates them as staged projections and
runs all sequential leaf transforms of a request in one grouped pass.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import series
from ..functions.series import Axis
from ..operators.sequential import run_folds
from .transforms import EWMA, REGISTRY, Lag, RollingStd, RollingSum, Sequential, SMA, Transform, ref

BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": series.div,
    "radd": lambda a, b: b + a,
    "rsub": lambda a, b: b - a,
    "rmul": lambda a, b: b * a,
    "rdiv": lambda a, b: series.div(b, a),
    "min": series.null_min,
    "max": series.null_max,
}
UNARY: dict[str, Callable[..., Column]] = {
    "abs": F.abs,
    "log": series.safe_log,
    "log1p": series.safe_log1p,
    "sqrt": series.safe_sqrt,
    "exp": F.exp,
    "square": lambda x: x * x,
    "clip": lambda x, lower=None, upper=None: series.clip(x, lower, upper),
}


class Node(Transform):
    """Inner node of an expression: adds its children, then one column."""

    children: list[Transform]

    def _add_children(self, df: DataFrame, ax: Axis) -> DataFrame:
        for c in self.children:
            if not set(c.produces) <= set(df.columns):
                df = c.add(df, ax)
        return df

    def validate(self, columns: list[str]) -> None:
        for c in self.children:
            c.validate(columns)


class BinaryOp(Node):
    def __init__(self, op: str, left: Transform, right: Transform | float) -> None:
        self.op, self.children = op, [left] + ([right] if isinstance(right, Transform) else [])
        self.constant = None if isinstance(right, Transform) else right
        names = [c.produces[0] for c in self.children] + ([] if self.constant is None else [str(self.constant)])
        self.requires = list(dict.fromkeys(r for c in self.children for r in c.requires))
        self.produces, self.params = [f"{op}({','.join(names)})"], {}

    def add(self, df: DataFrame, ax: Axis) -> DataFrame:
        df = self._add_children(df, ax)
        right = F.lit(self.constant) if self.constant is not None else ref(self.children[1].produces[0])
        return df.withColumn(self.produces[0], BINARY[self.op](ref(self.children[0].produces[0]), right))

    def to_config(self) -> dict:
        return {"binary": self.op, "left": self.children[0].to_config(), "right": self.children[1].to_config() if self.constant is None else self.constant}


class UnaryOp(Node):
    def __init__(self, op: str, child: Transform, func: Callable | None = None, suffix: str | None = None, **params: object) -> None:
        self.op, self.children, self.params, self.func = op, [child], params, func
        self.requires = list(child.requires)
        shown = suffix or "_".join([op, *(str(v) for v in params.values())]) if params or suffix else None
        self.produces = [f"{child.produces[0]}_{shown}" if shown else f"{op}({child.produces[0]})"]

    def add(self, df: DataFrame, ax: Axis) -> DataFrame:
        df = self._add_children(df, ax)
        f = self.func or UNARY[self.op]
        return df.withColumn(self.produces[0], f(ref(self.children[0].produces[0]), **self.params))

    def to_config(self) -> dict:
        if self.func is not None:
            raise ValueError("an expression with a callable has no JSON form")
        return {"unary": self.op, "child": self.children[0].to_config(), "args": self.params}


class Compose(Node):
    """Pipes transforms: the outputs of one are the inputs of the next."""

    def __init__(self, *transforms: Transform) -> None:
        if not transforms:
            raise ValueError("nothing to compose")
        self.children, self.params = list(transforms), {}
        self.requires = list(transforms[0].requires)
        last = transforms[-1]
        suffixes = [p.removeprefix(f"{t.requires[0]}_") if len(t.requires) == 1 else p for t in transforms[1:-1] for p in t.produces[:1]]
        ends = [p.removeprefix(f"{last.requires[0]}_") if len(last.requires) == 1 else p for p in last.produces] if len(transforms) > 1 else []
        head = transforms[0].produces[0]
        self.produces = ["_".join([head, *suffixes, e]) for e in ends] or list(transforms[0].produces)

    def add(self, df: DataFrame, ax: Axis) -> DataFrame:
        first, *rest = self.children
        kept = df.columns
        if not set(first.produces) <= set(df.columns):
            df = first.add(df, ax)
        ins = first.produces
        for k, t in enumerate(rest):
            moved = rebind(t, ins if len(t.requires) > 1 or len(ins) == 1 else ins[:1])
            outs = self.produces if k == len(rest) - 1 else moved.produces
            df = moved.add(df, ax)
            for a, b in zip(moved.produces, outs, strict=True):
                if a != b:
                    df = df.withColumnRenamed(a, b)
            ins = outs
        return df.select(*[ref(c) for c in kept], *[ref(c) for c in self.produces if c not in kept])

    def to_config(self) -> dict:
        return {"compose": [t.to_config() for t in self.children]}


def rebind(t: Transform, inputs: Sequence[str]) -> Transform:
    """The same transform over other input columns."""
    p = dict(t.params)
    key = "input_col" if "input_col" in p else "input_cols"
    p[key] = inputs[0] if key == "input_col" else list(inputs)
    return type(t)(**p)


class Feature:
    """A named expression; arithmetic builds new ones."""

    def __init__(self, transform: Transform) -> None:
        self.transform, self._name = transform, None

    @property
    def name(self) -> str | list[str]:
        return self._name or self.transform.output_name

    @name.setter
    def name(self, value: str | list[str]) -> None:
        many = isinstance(self.transform.output_name, list)
        if many != isinstance(value, list):
            raise TypeError("a name for each output is needed")
        if many and len(value) != len(self.transform.output_name):
            raise ValueError("as many names as outputs are needed")
        self._name = value

    def rename(self, name: str | list[str]) -> Feature:
        self.name = name
        return self

    def _binary(self, op: str, other: Feature | float) -> Feature:
        if isinstance(other, Feature):
            return Feature(BinaryOp(op, self.transform, other.transform))
        if isinstance(other, (int, float)) and not isinstance(other, bool):
            return Feature(BinaryOp(op, self.transform, other))
        return NotImplemented

    def __add__(self, o): return self._binary("add", o)  # noqa: E704
    def __sub__(self, o): return self._binary("sub", o)  # noqa: E704
    def __mul__(self, o): return self._binary("mul", o)  # noqa: E704
    def __truediv__(self, o): return self._binary("div", o)  # noqa: E704
    def __radd__(self, o): return self._binary("radd", o)  # noqa: E704
    def __rsub__(self, o): return self._binary("rsub", o)  # noqa: E704
    def __rmul__(self, o): return self._binary("rmul", o)  # noqa: E704
    def __rtruediv__(self, o): return self._binary("rdiv", o)  # noqa: E704
    def __abs__(self): return self.abs()  # noqa: E704

    def _unary(self, op: str, **params: object) -> Feature:
        return Feature(UnaryOp(op, self.transform, **params))

    def abs(self) -> Feature:
        return self._unary("abs")

    def log(self) -> Feature:
        return self._unary("log")

    def log1p(self) -> Feature:
        return self._unary("log1p")

    def exp(self) -> Feature:
        return self._unary("exp")

    def sqrt(self) -> Feature:
        return self._unary("sqrt")

    def square(self) -> Feature:
        return self._unary("square")

    def clip(self, lower: float | None = None, upper: float | None = None) -> Feature:
        return self._unary("clip", lower=lower, upper=upper)

    def apply(self, func: Callable[..., Column], suffix: str | None = None, **kwargs: object) -> Feature:
        """A Column -> Column callable; whole-series callables are ExternalFunction."""
        return Feature(UnaryOp("apply", self.transform, func, suffix or getattr(func, "__name__", "func"), **kwargs))

    def _then(self, make: Callable[[str], Transform]) -> Feature:
        return Feature(Compose(self.transform, make(self.transform.produces[0])))

    def rolling_mean(self, n: int) -> Feature:
        return self._then(lambda c: SMA(n, input_col=c))

    def rolling_sum(self, n: int) -> Feature:
        return self._then(lambda c: RollingSum(n, input_col=c))

    def rolling_std(self, n: int) -> Feature:
        return self._then(lambda c: RollingStd(n, input_col=c))

    def ema(self, span: int, adjust: bool = True) -> Feature:
        return self._then(lambda c: EWMA(span, input_col=c))

    def lag(self, n: int = 1) -> Feature:
        return self._then(lambda c: Lag(n, input_col=c))

    @staticmethod
    def min(a: Feature, b: Feature | float) -> Feature:
        return a._binary("min", b)

    @staticmethod
    def max(a: Feature, b: Feature | float) -> Feature:
        return a._binary("max", b)

    def to_config(self) -> dict:
        return {"name": self._name, "transform": self.transform.to_config()}

    @classmethod
    def from_config(cls, config: dict) -> Feature:
        f = cls(transform_from_config(config["transform"]))
        if config.get("name"):
            f.name = config["name"]
        return f


def transform_from_config(c: dict) -> Transform:
    if "binary" in c:
        right = c["right"]
        return BinaryOp(c["binary"], transform_from_config(c["left"]), transform_from_config(right) if isinstance(right, dict) else right)
    if "unary" in c:
        return UnaryOp(c["unary"], transform_from_config(c["child"]), **c["args"])
    if "compose" in c:
        return Compose(*map(transform_from_config, c["compose"]))
    if c["op"] not in REGISTRY:
        raise ValueError(f"unknown transform {c['op']}")
    return REGISTRY[c["op"]](**{k: timedelta(seconds=v["__timedelta__"]) if isinstance(v, dict) and "__timedelta__" in v else v for k, v in c["args"].items()})


class Graph:
    """Dependencies between features and ``input:`` columns."""

    def __init__(self) -> None:
        self.edges: dict[str, set[str]] = {}

    def link(self, src: str, dst: str) -> None:
        self.edges.setdefault(src, set()).add(dst)
        self.edges.setdefault(dst, set())

    def order(self) -> list[str]:
        """Sources before what depends on them; nodes on a cycle are left out."""
        waiting = {n: sum(n in d for d in self.edges.values()) for n in self.edges}
        ready, out = sorted(n for n, k in waiting.items() if not k), []
        while ready:
            n = ready.pop(0)
            out.append(n)
            for d in sorted(self.edges[n]):
                waiting[d] -= 1
                if not waiting[d]:
                    ready.append(d)
        return out

    def visualize(self) -> str:
        return "\n".join(["ComputationGraph:", *(f"  {s} -> [{', '.join(sorted(d))}]" for s, d in sorted(self.edges.items()))])


def _parts(t: Transform) -> list[Transform]:
    return [t] if not isinstance(t, Node) else [t, *(p for c in t.children for p in _parts(c))]


class FeatureKit:
    """A list of features and the columns to retain."""

    def __init__(self, features: list[Feature], retain: list[str] | None = None) -> None:
        self.features, self.retain = features, retain or []

    def build_graph(self) -> Graph:
        g = Graph()
        outs = {str(f.transform.output_name): str(f.name) for f in self.features}
        for f in self.features:
            g.edges.setdefault(str(f.name), set())
            for r in f.transform.requires:
                g.link(f"input:{r}", str(f.name))
                if r in outs and outs[r] != str(f.name):
                    g.link(outs[r], str(f.name))
            for p in _parts(f.transform)[1:]:
                if str(p.output_name) in outs and outs[str(p.output_name)] != str(f.name):
                    g.link(outs[str(p.output_name)], str(f.name))
        return g

    def topological_order(self) -> list[Feature]:
        rank = {n: k for k, n in enumerate(self.build_graph().order())}
        return sorted(self.features, key=lambda f: rank.get(str(f.name), len(rank)))

    def build(self, df: DataFrame, *, ax: Axis | None = None, backend: str = "spark", order: str = "defined", timeit: bool = False) -> DataFrame:
        """Key columns, retained columns and features, in the order of their definition."""
        if backend not in ("spark", "pd", "nb"):
            raise ValueError(f"unknown backend {backend}")
        ax = ax or Axis()
        # sequential leaves over input columns: one grouped pass for all of them
        folds = {}
        for f in self.features:
            for p in _parts(f.transform):
                if isinstance(p, Sequential) and set(p.requires) <= set(df.columns) and not set(p.produces) <= set(df.columns):
                    folds[str(p.produces)] = p
        keys = list(dict.fromkeys([*ax.by, *ax.order, ax.time]))
        out = run_folds(df, [p.as_fold(ax) for p in folds.values()], ax.by, ax.order) if folds else df
        names: dict[str, str] = {}
        for f in self.topological_order() if order == "topo" else self.features:
            if not isinstance(f, Feature):
                raise TypeError("features are needed")
            start = time.perf_counter()
            if not set(f.transform.produces) <= set(out.columns):
                out = f.transform.add(out, ax)
            new = f.name if isinstance(f.name, list) else [f.name]
            names |= dict(zip(new, f.transform.produces, strict=True))
            if timeit:
                out.select(*[ref(p) for p in f.transform.produces]).write.format("noop").mode("overwrite").save()
                print(f"{f.name}: {time.perf_counter() - start:.3f} s")
        kept = list(dict.fromkeys([*keys, *self.retain]))
        order_of = [n for f in self.features for n in (f.name if isinstance(f.name, list) else [f.name])]
        return out.select(*[ref(c) for c in kept], *[ref(names[n]).alias(n) for n in order_of if n not in kept])

    def to_config(self) -> dict:
        return {"retain": self.retain, "features": [f.to_config() for f in self.features]}

    def save_config(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(self.to_config(), f, indent=1)

    @classmethod
    def from_dict(cls, config: dict) -> FeatureKit:
        return cls([Feature.from_config(c) for c in config["features"]], config["retain"])

    @classmethod
    def from_config(cls, path: str) -> FeatureKit:
        with open(path) as f:
            return cls.from_dict(json.load(f))
