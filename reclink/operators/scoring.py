"""Pair scorers trained with Spark ML: logistic regression, and boosted trees behind a cheap gate.

Pairs are those of the exact routes over the first 18 words of documents, with their 107 features. The label is whether
the whole documents share half of their words, which the features do not see.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reclink.operators import linkage
from reclink.sources import scratch

FULL = [f"f{i}" for i in range(107)]
CHEAP = ["f0", "f3", "f4", "f7"]
SHARES = {"fit": 70, "calibrate": 85, "audit": 100}


def part_of(q: Column) -> Column:
    """fit, calibrate or audit: all pairs of a query are in one part."""
    h = F.pmod(F.crc32(q.cast("binary")), F.lit(100))
    return F.when(h < SHARES["fit"], "fit").when(h < SHARES["calibrate"], "calibrate").otherwise("audit")


def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, rid, f0 .., label, part), stored, as several passes read it."""
    from reclink.plans import catalogue

    words = F.array_distinct(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select(F.concat(F.lit("S"), F.lit(1) + F.col("doc_id") % 3, F.lit("-"), F.col("doc_id")).alias("id"), words.alias("w"))
    pairs = catalogue.run(catalogue.feature_vector, spark, sf_dir)
    both = pairs.join(docs.select(F.col("id").alias("q"), F.col("w").alias("a")), "q").join(docs.select(F.col("id").alias("rid"), F.col("w").alias("b")), "rid")
    label = (2 * F.size(F.array_intersect("a", "b")) >= F.size(F.array_union("a", "b"))).cast("double").alias("label")
    return scratch.stored(both.select("q", "rid", *FULL, label, part_of(F.col("q")).alias("part")), "labelled-pairs")


def fitted(pairs: DataFrame, columns: list[str], classifier):
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), classifier]).fit(pairs.where("part = 'fit'"))


def scored(pairs: DataFrame, model, name: str = "score") -> DataFrame:
    return model.transform(pairs).withColumn(name, F.get(vector_to_array("probability"), F.lit(1))).drop("features", "rawPrediction", "probability", "prediction")


def trained_lr_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = labelled_pairs(spark, sf_dir)
    return scored(pairs, fitted(pairs, FULL, LogisticRegression(standardization=True, regParam=2e-4, maxIter=60))).select("q", "rid", "part", "label", F.round("score", 4).alias("score"))


def trained_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade: a model of four features gives each pair a gate value; the gate is the largest that loses nothing on
    the calibration part, and only pairs that pass it reach the trees over all features."""
    pairs = labelled_pairs(spark, sf_dir)
    cheap = fitted(pairs, CHEAP, LogisticRegression(regParam=1e-3))
    trees = fitted(pairs, FULL, GBTClassifier(maxIter=8, maxDepth=3, seed=81))
    gated = scored(pairs, cheap, "gate")
    judged = scored(gated.where("part = 'calibrate'"), trees, "full")
    gate, _ = linkage.choose_gate(judged, 0.5)
    return linkage.cascade(gated, gate, lambda rest: scored(rest, trees)).select("q", "rid", "part", "label", F.round("score", 4).alias("score"))
