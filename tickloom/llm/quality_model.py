"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

The model sees trusted positives (``quality`` = 1) and unlabelled web text, never a trusted
negative. With class prior p and logistic loss it minimises

    p R+(positives) + max(0, R-(unlabelled) - p R-(positives))

(Kiryo et al., 2017): the second term estimates the negatives' risk without negatives; where a
batch drives it below zero, the step goes the other way. The prior is estimated from the same two
samples by best bin estimation; with fewer than ``least`` rows in one it is ``default_prior``.

Features are relative frequencies of hashed byte-shape trigrams (letters by case, digits, white
space and each punctuation mark are a shape) and a few text statistics, all over the whole text.
Labels, language, source and id are no inputs. The fit uses a bounded sample, ``per_side`` positive
and ``per_side`` unlabelled rows in the order of a hash; scoring covers every row.

Defined cases: a null or empty text has zero features and the score of the bias; without any
positive training row every score is ``default_prior``; repeated labels of a row count once each;
repeated rows are scored alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .textops import SPACE, chunks, column_bytes, prefix, release_memory, span_hash, trimmed, words

DIM = 2048
STATS = 12

#: shape of a byte: lower-case, upper-case, digit, space, line end, beyond ASCII; others are themselves
SHAPE = np.arange(256, dtype=np.uint64)
SHAPE[97:123], SHAPE[65:91], SHAPE[48:58], SHAPE[128:] = 1, 2, 3, 1
SHAPE[32] = 4
SHAPE[[9, 11, 12, 13]] = 5


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, DIM + STATS) float32."""
    m = len(offs) - 1
    out = np.zeros((m, DIM + STATS), np.float32)
    size = np.diff(offs)
    n = len(data)
    if n == 0:
        return out
    doc = np.repeat(np.arange(m), size)
    if n > 2:
        s = SHAPE[data]
        code = (s[:-2] * np.uint64(0x9E3779B97F4A7C15) + s[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + s[2:] * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
        same = doc[:-2] == doc[2:]
        at = doc[:-2][same] * DIM + (code[same] >> np.uint64(53)).astype(np.int64)
        out[:, :DIM] = np.bincount(at, minlength=m * DIM).reshape(m, DIM) / np.maximum(size[:, None] - 2, 1)
    share = lambda mask: np.add.reduceat(np.append(mask, 0).astype(np.float64), np.minimum(offs[:-1], n)) * (size > 0) / np.maximum(size, 1)
    upper = (data >= 65) & (data <= 90)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    digit = (data >= 48) & (data <= 57)
    start, end, wd = words(data, offs)
    nw = np.bincount(wd, minlength=m)
    h = span_hash(prefix(data), start, end)
    kinds = _distinct(wd, h, m)
    three = h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7) if len(h) > 2 else h[:0]
    ok = wd[:-2] == wd[2:] if len(h) > 2 else np.zeros(0, bool)
    tri = _distinct(wd[:-2][ok], three[ok], m) if len(h) > 2 else np.zeros(m)
    lines = np.bincount(doc[data == 10], minlength=m)
    length = np.bincount(wd, end - start, m)
    x = out[:, DIM:]
    x[:, 0] = np.log1p(nw)
    x[:, 1] = length / np.maximum(nw, 1)
    x[:, 2] = kinds / np.maximum(nw, 1)
    x[:, 3] = 1 - tri / np.maximum(nw - 2, 1) * (nw > 2)
    x[:, 4] = share(upper)
    x[:, 5] = share(digit)
    x[:, 6] = share(~letter & ~digit & ~SPACE[data])
    x[:, 7] = share(SPACE[data])
    x[:, 8] = lines / np.maximum(nw, 1)
    x[:, 9] = np.sqrt(np.maximum(np.bincount(wd, (end - start).astype(float) ** 2, m) / np.maximum(nw, 1) - x[:, 1] ** 2, 0))
    x[:, 10] = nw < 30
    x[:, 11] = np.isin(data[np.minimum(np.maximum(offs[1:] - 1, 0), n - 1)], [33, 46, 63]) & (size > 0)
    return out


def _distinct(group: np.ndarray, value: np.ndarray, m: int) -> np.ndarray:
    """Distinct values of each group."""
    if not len(group):
        return np.zeros(m, np.int64)
    o = np.lexsort((value, group))
    g, v = group[o], value[o]
    first = np.append(True, (g[1:] != g[:-1]) | (v[1:] != v[:-1]))
    return np.bincount(g[first], minlength=m)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def minimise(pos: np.ndarray, unl: np.ndarray, slopes: Callable, bias: float, epochs: int, rate: float, decay: float, batch: int, seed: int) -> tuple[np.ndarray, float]:
    """Linear model by Adam; slopes(scores of positives, of unlabelled rows) are the risk's derivatives by each row's logit."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(pos.shape[1]), bias
    m1, m2, t = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0
    steps = max(1, min(len(pos), len(unl)) // batch)
    for _ in range(epochs):
        pp, uu = np.array_split(rng.permutation(len(pos)), steps), np.array_split(rng.permutation(len(unl)), steps)
        for ip, iu in zip(pp, uu, strict=True):
            xp, xu = pos[ip], unl[iu]
            a_p, a_u = slopes(_sigmoid(xp @ w + b), _sigmoid(xu @ w + b))
            g = np.append(xp.T @ a_p + xu.T @ a_u + decay * w, a_p.sum() + a_u.sum())
            t += 1
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
            step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1], b - float(step[-1])
    return w, b


def pu_risk(sp: np.ndarray, su: np.ndarray, prior: float) -> tuple[float, float]:
    """(positives' risk, estimate of the negatives' risk before it is clipped at 0) with logistic loss."""
    low = lambda x: -np.log(np.maximum(x, 1e-12))
    return prior * low(sp).mean(), low(1 - su).mean() - prior * low(1 - sp).mean()


def pu_slopes(prior: float) -> Callable:
    def slopes(sp: np.ndarray, su: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gp, gn_u, gn_p = (sp - 1) / len(sp), su / len(su), sp / len(sp)
        if pu_risk(sp, su, prior)[1] >= 0:
            return prior * gp - prior * gn_p, gn_u
        return prior * gn_p, -gn_u  # only undo the overfitted part

    return slopes


def nn_pu(pos: np.ndarray, unl: np.ndarray, prior: float, epochs: int, rate: float, decay: float, batch: int, seed: int) -> tuple[np.ndarray, float]:
    """Linear logistic model by Adam on the non-negative PU risk."""
    return minimise(pos, unl, pu_slopes(prior), float(np.log(prior / (1 - prior))), epochs, rate, decay, batch, seed)


def best_bin(sp: np.ndarray, su: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Share of positives among the unlabelled from scores of both (best bin estimation, Garg et al., 2021).

    Above any score the unlabelled hold at least that share of what the positives hold; the bound is
    read where it is tightest with its sampling error.
    """
    cut = np.sort(np.concatenate([sp, su]))
    qp, qu = (1 - np.searchsorted(np.sort(x), cut) / len(x) for x in (sp, su))
    error = (1 + gamma) * sum(np.sqrt(np.log(4 / delta) / 2 / len(x)) for x in (sp, su))
    at = np.argmin((qu + error) / np.maximum(qp, 1e-12))
    return float(qu[at] / qp[at])


def class_prior(pos: np.ndarray, unl: np.ndarray, epochs: int, rate: float, decay: float, batch: int, seed: int) -> float:
    """Prior from positives and unlabelled rows alone: a logistic model tells them apart on one half and is read on the other, both ways."""
    against = lambda sp, su: ((sp - 1) / (2 * len(sp)), su / (2 * len(su)))
    found = []
    for k in (0, 1):
        w, b = minimise(pos[k::2], unl[k::2], against, 0.0, epochs, rate, decay, batch, seed + k)
        found.append(best_bin(pos[1 - k :: 2] @ w + b, unl[1 - k :: 2] @ w + b))
    return min(0.99, max(0.01, float(np.mean(found))))


def fit(train: DataFrame, per_side: int = 3000, default_prior: float = 0.85, least: int = 100, epochs: int = 40, rate: float = 0.005, decay: float = 1e-3, seed: int = 11) -> Model:
    """train: (id, text, label); rows of label 1 are the positives, the labels of all others are not looked at."""
    small_batches(train.sparkSession)
    n_pos, n_all = train.agg(F.count(F.when(F.col("label") == 1, 1)), F.count("*")).first()
    if not n_pos:
        return Model(np.zeros(DIM + STATS), np.ones(DIM + STATS), np.zeros(DIM + STATS), float(np.log(default_prior / (1 - default_prior))))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = column_bytes(batch.column(1))
            for a, b, d, o in chunks(data, offs, 1 << 19):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([zlib.compress(r.tobytes(), 1) for r in features(d, o)], pa.binary())], ["u", "x"])

    parts = {}
    # two independent draws: positives, and rows of all kinds whose labels are not looked at
    for side, rows, n in ((1, train.where("label = 1"), n_pos), (0, train, n_all)):
        unit = (F.xxhash64(F.lit(seed + 1 - side), "id") / F.lit(2.0**64)) + 0.5
        drawn = rows.withColumn("u", unit).where(F.col("u") <= 1.3 * (per_side + 20) / n)
        # features are taken where the texts are; of a fixed size, so the rows' number bounds what is gathered; mostly zeros, so packed
        sample = drawn.select("u", "text").mapInArrow(trimmed(extract), "u double, x binary").orderBy("u", "x").limit(per_side).toArrow().column("x")
        out = np.empty((len(sample), DIM + STATS), np.float32)
        for k, v in enumerate(sample):
            out[k] = np.frombuffer(zlib.decompress(v.as_py()), np.float32)
        parts[side] = out
        del sample
    mean = parts[0].mean(0, dtype=np.float64).astype(np.float32)
    scale = (parts[0].std(0) + 1e-3 * (np.arange(DIM + STATS) < DIM) + 1e-6).astype(np.float32)
    z = parts
    for v in z.values():
        v -= mean
        v /= scale
        np.clip(v, -8, 8, out=v)
    prior = class_prior(z[1], z[0], epochs // 2, rate, decay, 256, seed) if min(map(len, z.values())) >= least else default_prior
    w, b = nn_pu(z[1], z[0], prior, epochs, rate, decay, 256, seed)
    del parts, z
    release_memory()
    return Model(mean, scale, w, b)


def score(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """df with the score, in place of a column of that name."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    @trimmed
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            data, offs = column_bytes(texts)
            out = np.zeros(len(texts))
            for a, b, d, o in chunks(data, offs, 1 << 19):
                out[a:b] = shared.value.scores(features(d, o))
            yield pa.array(out)

    return df.withColumn(name, run(F.col(text)))
