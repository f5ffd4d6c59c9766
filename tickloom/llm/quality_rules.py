"""Host-level quality rules. DataFrame functions only.

Each document gets rule figures from its words and lines. Failures are summed by host (for the
synthetic tables: the source), the hosts' failure rates are shrunk towards an empirical beta
prior, and the verdict on each host is joined back: documents of a host whose shrunk rate is above
``max_rate`` are rejected, whatever their own figures.

The prior is fitted by moments: with mean m = failures / documents over all hosts and s the
document-weighted variance of the rates, the spread between hosts is b = s - m(1-m) hosts/documents
(what binomial noise adds is taken off), the prior's weight is k = m(1-m)/b - 1 documents within
[1, 1e6], and a host's rate is (failures + m k) / (documents + k). A host with few documents stays
near m and is not condemned by one of them.

Repeated 3-word windows are found inside the row: window hashes (xxhash64) with their positions in
the low bits are sorted as one primitive array, equal neighbours are windows that occur twice; no
row leaves its document and nothing is quadratic in a document's length.

Defined cases: null and blank texts have no words and fail the base rule; the null host is a host;
repeated rows count as often as they stand; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, split_words


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_figures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), in place of columns of those names."""
    q = "_q_"
    while any(c.lower().startswith(q) for c in df.columns):
        q += "q_"
    name, sql = lambda c: q + c, lambda x: F.expr(x.replace("_q_", q))
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    keep = [c for c in df.columns if c not in FIGURES]
    d = df.select(*keep, split_words(F.col(text)).alias(name("w")), lines.alias(name("l")), F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    d = d.select(*keep, "n_symbols", F.size(name("w")).cast("long").alias("n_words"), F.length(F.array_join(name("w"), "")).cast("long").alias("word_chars"), (F.size(name("l")) - F.size(F.array_distinct(name("l")))).cast("long").alias("n_dup_lines"), F.transform(name("w"), lambda x: F.xxhash64(x)).alias(name("h")))
    windows = sql("IF(n_words < 3, CAST(array() AS array<bigint>), transform(sequence(0, CAST(n_words AS int) - 3), i -> xxhash64(get(_q_h, i), get(_q_h, i + 1), get(_q_h, i + 2))))")
    # the low bits hold the position: 20 of them, or as many as the text needs
    low = sql("shiftleft(1L, greatest(20, CAST(ceil(log2(n_words + 2.0D)) AS int))) - 1")
    d = d.select(*keep, "n_symbols", "n_words", "word_chars", "n_dup_lines", windows.alias(name("t")), low.alias(name("m")))
    d = d.withColumn(name("s"), sql("sort_array(transform(_q_t, (x, i) -> (x & ~_q_m) | CAST(i AS bigint)))"))
    same = "coalesce(((get(_q_s, j {0}) ^ x) & ~_q_m) = 0L, false)"
    equal = "get(_q_t, CAST(get(_q_s, j {0}) & _q_m AS int)) = get(_q_t, CAST(x & _q_m AS int))"
    side = lambda a, b: f"({same.format(a)} AND ({equal.format(a)} OR ({same.format(b)} AND {equal.format(b)})))"
    at = f"sort_array(filter(transform(_q_s, (x, j) -> IF({side('+ 1', '+ 2')} OR {side('- 1', '- 2')}, x & _q_m, -1L)), p -> p >= 0L))"
    d = d.withColumn(name("p"), sql(at))
    covered = "aggregate(transform(_q_p, (p, k) -> least(3L, coalesce(get(_q_p, k + 1) - p, 3L))), 0L, (a, b) -> a + b)"
    return d.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", sql(covered).alias("n_repeat_words"))


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def host_rates(df: DataFrame, host: str, failed: str) -> DataFrame:
    """(host, n_docs, n_failed, rate): rates shrunk by the empirical beta prior."""
    hosts = df.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    sums = hosts.agg(F.count("*").cast("double").alias("k"), F.sum("n_docs").cast("double").alias("n"), F.sum("n_failed").cast("double").alias("f"), F.sum(F.col("n_failed").cast("double") * F.col("n_failed") / F.col("n_docs")).alias("ff"))
    m = F.col("f") / F.col("n")
    noise = m * (1 - m)
    between = F.greatest(F.col("ff") / F.col("n") - m * m - noise * F.col("k") / F.col("n"), F.lit(1e-9))
    prior = sums.select(m.alias("m"), F.least(F.greatest(noise / between - 1, F.lit(1.0)), F.lit(1e6)).alias("w"))
    mean, weight = prior.select("m").scalar(), prior.select("w").scalar()
    return hosts.select("host", "n_docs", "n_failed", ((F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight)).alias("rate"))


def judge(docs: DataFrame, host: str = "source", doc_id: str = "doc_id", text: str = "text", max_rate: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """doc_id, host, the figures, base_failed, host_rate, kept: a row per row of docs."""
    stage = Stage(docs.sparkSession, "rules")
    d = with_figures(docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text")), "text").drop("text")
    d = stage.put(d.withColumn("base_failed", base_failed(min_words, max_repeat_percent)), "figures")
    rates = host_rates(d, "host", "base_failed").select(F.col("host").alias("_h"), F.col("rate").alias("host_rate"))
    out = d.join(rates, F.col("host").eqNullSafe(F.col("_h"))).drop("_h")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_rate))
