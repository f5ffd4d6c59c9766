"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character bigrams and trigrams of the lower-cased text, weighted by relative
frequency times inverse document frequency. Document frequencies are counted over every training
document. The model is fitted on a bounded sample, ``per_class`` documents of each language in the
order of a hash, by follow-the-regularised-leader with elastic-net penalties, one document at a
time; the penalties leave most weights at zero. A temperature is then fitted to other training
documents, so that the scores are calibrated. Prediction reads whole texts.

What is broadcast has a fixed size: ``DIM`` x languages weights, at most ``max_classes`` languages.

Defined cases: a null text or one without a letter is ``und`` with score 0; rows with null lang or
null id are not learned from; with no training rows all is ``und``; ties go to the first language
in code-point order; repeated rows are predicted alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_names

DIM = 1 << 15
LETTER = re.compile(r"[^\W\d_]")
PIECE = 1 << 19


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every bigram and trigram; a text is framed by line ends."""
    joined = "\n" + "\n\n".join(texts) + "\n" if texts else ""
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts)), sizes)
    out_b, out_d = [], []
    two = cp[:-1] * np.uint64(0x9E3779B97F4A7C15) + cp[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two[:-1] * np.uint64(0xD6E8FEB86659FD93) + cp[2:] * np.uint64(0x165667B19E3779F9)
    for h, k in ((two, 1), (three, 2)):
        ok = doc[:-k] == doc[k:]
        out_b.append((h >> np.uint64(49)).astype(np.int32)[ok])
        out_d.append(doc[:-k][ok])
    return np.concatenate(out_b), np.concatenate(out_d)


def pieces(texts: pa.Array, most: int = PIECE) -> Iterator[tuple[int, list[str]]]:
    """(first, lower-cased texts) of about ``most`` characters; nulls are empty."""
    start, held, size = 0, [], 0
    for k, t in enumerate(texts):
        t = (t.as_py() or "").lower()
        if held and size + len(t) > most:
            yield start, held
            start, held, size = k, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield start, held


@dataclass
class Model:
    classes: list[str]
    weights: np.ndarray  # (DIM, classes), the inverse document frequency is multiplied in
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str]) -> np.ndarray:
        b, d = grams(texts)
        n = np.maximum(np.bincount(d, minlength=len(texts)), 1)
        z = np.stack([np.bincount(d, self.weights[b, c], len(texts)) for c in range(len(self.classes))], 1)
        return z / n[:, None] + self.bias

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float, beta: float, l1: float, l2: float, epochs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Per-coordinate FTRL-proximal (McMahan et al., 2013) on (buckets, values, class) rows."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            i, x, y = rows[r]
            w = weight(i)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            g2 = g * g
            z[i] += g - (np.sqrt(n[i] + g2) - np.sqrt(n[i])) / alpha * w
            n[i] += g2
    w = weight(np.arange(DIM + 1))
    return w[:DIM], w[DIM]


def _document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """Over every training document: counted per batch, summed by Spark; DIM + 1 rows come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIM + 1, np.int64)
        for batch in batches:
            for _, texts in pieces(batch.column(0)):
                b, d = grams(texts)
                seen = np.unique(d * DIM + b)
                df[:DIM] += np.bincount(seen % DIM, minlength=DIM)
            df[DIM] += batch.num_rows
        k = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(df[k])], ["k", "n"])

    df = np.zeros(DIM + 1, np.int64)
    for k, n in train.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n")).collect():
        df[k] = n
    return df[:DIM], int(df[DIM])


def _features(texts: list[str], idf: np.ndarray, scale: float) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for t in texts:
        b, _ = grams([t])
        i, c = np.unique(b, return_counts=True)
        out.append((np.append(i, DIM).astype(np.int64), np.append(scale * c / max(len(b), 1) * idf[i], 1.0)))
    return out


def fit(train: DataFrame, per_class: int = 600, calibration: int = 200, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01, epochs: int = 3, max_classes: int = 1000, most_rows: int = 20_000, seed: int = 7) -> Model | None:
    """train: (id, text, lang). Fits on ``per_class`` and calibrates on ``calibration`` more rows of each language, fewer of each where that is over ``most_rows`` in all."""
    sizes = {r[0]: r[1] for r in train.groupBy("lang").count().orderBy("lang").limit(max_classes + 1).collect()}
    if not sizes or len(sizes) > max_classes:
        if sizes:
            raise ValueError(f"more than {max_classes} languages")
        return None
    classes = sorted(sizes)
    less = min(1.0, most_rows / (len(classes) * (per_class + calibration)))
    per_class, calibration = max(1, int(per_class * less)), max(1, int(calibration * less))
    df, n_docs = _document_frequencies(train)
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    # a hash below a language's own threshold leaves a little over the wanted rows of it, whatever its share
    want = per_class + calibration
    unit = (F.xxhash64(F.lit(seed), "id") / F.lit(2.0**64)) + 0.5
    share = F.create_map(*[x for c in classes for x in (F.lit(c), F.lit(min(1.0, 1.5 * (want + 20) / sizes[c])))])
    sample = train.withColumn("u", unit).where(F.col("u") <= share[F.col("lang")])
    sample = sample.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("u", "id", F.md5("text")))).where(F.col("k") <= want).select("lang", "k", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in pieces(batch.column(2)):
                f = _features(texts, idf, 1.0)
                part = batch.slice(a, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int32()), pa.array([i.astype(np.int32).tobytes() for i, _ in f], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in f], pa.binary())], ["lang", "k", "i", "x"])

    scale = 30.0
    fitting, holding = [], []
    at = {c: j for j, c in enumerate(classes)}
    for lang, k, i, x in sorted((tuple(r) for r in sample.mapInArrow(extract, "lang string, k int, i binary, x binary").collect()), key=lambda r: (r[1], r[0])):
        x = np.frombuffer(x, np.float32).astype(float) * scale
        x[-1] = 1.0
        held = k > per_class or (sizes[lang] <= per_class and k % 4 == 0)
        (holding if held else fitting).append((np.frombuffer(i, np.int32).astype(np.int64), x, at[lang]))
    w, bias = ftrl(fitting, len(classes), alpha, beta, l1, l2, epochs, seed)
    model = Model(classes, (w * (idf * scale)[:, None]).astype(np.float32), bias)
    rows = holding or fitting
    z = np.stack([x @ np.vstack([w, bias])[i] for i, x, _ in rows])
    y = np.array([c for *_, c in rows])
    model.temperature = _temperature(z, y)
    return model


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """Least negative log-likelihood over 1/20 to 20, by golden-section search on the logarithm."""

    def loss(u: float) -> float:
        p = softmax(z / np.exp(u))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()

    a, b, g = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def predict(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """df with lang_pred and score; columns of those names are replaced."""
    keep = [c for c in df.columns if c not in ("lang_pred", "score")]
    if model is None:
        return df.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def classify(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for series in parts:
            label, score = [], []
            for _, texts in pieces(pa.array(series, pa.string())):
                p = m.probabilities(texts)
                best = p.argmax(1)
                seen = [bool(LETTER.search(t)) for t in texts]
                label += [m.classes[b] if s else "und" for b, s in zip(best, seen, strict=True)]
                score += [float(p[j, b]) if s else 0.0 for j, (b, s) in enumerate(zip(best, seen, strict=True))]
            yield pd.DataFrame({"lang_pred": label, "score": score})

    (found,) = free_names(df, "_p")
    return df.withColumn(found, classify(F.col(text))).select(*keep, f"{found}.lang_pred", f"{found}.score")
