"""A corpus pipeline from the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on, with the columns of
``documents``; the last returns the mix. ``run`` applies them in turn, each to the written result
of the one before. Rows of equal id and text are copies everywhere.

1. quality: documents scored below 0.7 by the positive-unlabelled classifier go.
2. near_duplicates: of each group of 5-word-shingle Jaccard similarity 0.8, the row with the least
   id (then the least text hash) stays.
3. repeats: 200-byte strings that start twice or more are cut out of the texts; a text of which
   nothing is left goes, texts that were empty stay.
4. decontamination: documents that hold part of a benchmark item go.
5. mix: sources at weights 5, 2, 1, repeating, at most 3 epochs; ``copies`` is how often a document
   is taken, documents taken no times are left out.

Defined cases are those of the operators; empty tables pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, jaccard_join, mixing, quality_model, repeats
from tickloom.llm.common import SPACES, Stage, table
from tickloom.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
THRESHOLD = 0.7


def _row_key(df: DataFrame) -> DataFrame:
    return df.withColumn("_row", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00")), F.coalesce("text", F.lit("\x00"))))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("label"))
    train = docs.where("doc_id IS NOT NULL").join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), "text", "label")
    scored = quality_model.score(docs.select(*COLUMNS), quality_model.fit(train), name="_score")
    return scored.where(F.col("_score") >= THRESHOLD).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _row_key(docs.select(*COLUMNS))
    stage = Stage(spark, "near-duplicates")
    light, comp = jaccard_join.components(keyed.select(F.col("_row").alias("id"), "text"), stage, 5, 80)
    groups = light.join(comp, "cid", "left").select(F.col("id").alias("_row"), F.coalesce("comp", "cid").alias("comp"))
    # per group the least (id, row), combined map-side; texts without words are in no group and stay
    ids = keyed.select("doc_id", "_row").join(groups.distinct(), "_row")
    least = ids.where("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("m")).select(F.col("m._row").alias("_row"))
    alone = ids.where("comp IS NULL").select("_row").distinct()
    chosen = keyed.join(least.unionByName(alone), "_row", "left_semi")
    # one of equal rows; a text without words is a group of its own, so all of these stay
    blank = F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACES)) == ""
    chosen = chosen.withColumn("_blank", blank).withColumn("_key", F.when(F.col("_blank"), F.monotonically_increasing_id()).otherwise(F.col("_row")))
    first = F.row_number().over(W.partitionBy("_blank", "_key").orderBy("doc_id"))
    return chosen.withColumn("_first", first).where("_first = 1").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(docs.select(*COLUMNS))
    cut = F.size("spans") > 0
    # a cut may split a character: such bytes are dropped, by way of U+FFFD; a text's own U+FFFD is written as \x01 1 meanwhile
    swap = lambda c, *pairs: reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)
    valid = F.make_valid_utf8(swap(F.col("kept").cast("string"), ("\x01", "\x010"), ("\ufffd", "\x011")))
    text = F.when(cut, swap(valid, ("\ufffd", ""), ("\x011", "\ufffd"), ("\x010", "\x01"))).otherwise(F.col("text"))
    out = out.where(~cut | (F.length("kept") > 0)).withColumn("text", text)
    return out.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _row_key(docs.select(*COLUMNS))
    leaks = decontaminate.find_leaks(keyed, table(spark, sf_dir, "benchmark"), ["_row"])
    return keyed.join(leaks.select("_row").distinct(), "_row", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = mixing.mix(docs.select(*COLUMNS), [5, 2, 1], keep=["text", "lang", "source", "n_chars"])
    return out.where("copies > 0").select(*COLUMNS, "size", "copies", "taken")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", cut_repeats), ("decontamination", decontamination), ("mix", mix)]
#: the first stage is a trained model, which SQL cannot express; the tests hold every stage and the rows of run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    stage = Stage(spark, "pipeline")
    docs, last = table(spark, sf_dir, "documents"), None
    for name, f in STAGES:
        docs = stage.put(f(spark, docs, sf_dir), name)
        if last:
            stage.drop(last)
        last = name
    return docs
