"""Scores, labels and models over feature rows, and the decision that joins rules and models."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.sources.packages import ship

c = F.col

#: The features of the multiclass model.
FEATURES = ("total_packets", "total_bytes", "udp_packets", "tcp_packets", "icmp_packets", "syn_packets", "http_requests", "baseline_packets", "attack_packets", "udp_tcp_ratio", "syn_total_ratio", "baseline_attack_ratio", "bytes_per_packet")


def zscores(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``rows`` with (x - mean) / (population std + 1e-8) of columns under new names; the statistics are one row."""
    stats = rows.agg(*[f(x).alias(f"{x}_{n}") for x in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    out = rows.crossJoin(F.broadcast(stats))
    return out.withColumns({new: (c(x) - c(f"{x}_mean")) / (c(f"{x}_std") + 1e-8) for x, new in columns.items()}).drop(*stats.columns)


def rule_score(gbps_z: Column, pps_z: Column, syn_z: Column, udp_z: Column) -> Column:
    """A score from 0 to 1 of z-scored features."""
    part = lambda x, limit, add: F.when(x > limit, add).otherwise(0.0)
    return F.least(F.lit(1.0), part(gbps_z, 2, 0.3) + part(pps_z, 2, 0.2) + part(syn_z, 1.5, 0.3) + part(udp_z, 1.5, 0.25))


def attack_labels(syn: Column, udp: Column, frag: Column, limits=(0.7, 0.8, 0.3)) -> Column:
    """The labels that apply, joined by a bar; NORMAL without one."""
    found = F.array_compact(F.array(F.when(syn > limits[0], "SYN_FLOOD"), F.when(udp > limits[1], "UDP_FLOOD"), F.when(frag > limits[2], "FRAGMENTATION")))
    return F.when(F.size(found) == 0, "NORMAL").otherwise(F.array_join(found, "|"))


def model_features(counters: DataFrame) -> DataFrame:
    """The features of the multiclass model from windowed counters (packets, bytes, udp, tcp, icmp, syn, http, baseline, attack)."""
    guard = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(c(a).cast("double"))
    safe = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(0.0)
    return counters.select(
        "w", c("packets").alias("total_packets"), c("bytes").alias("total_bytes"), c("udp").alias("udp_packets"), c("tcp").alias("tcp_packets"), c("icmp").alias("icmp_packets"), c("syn").alias("syn_packets"), c("http").alias("http_requests"),
        c("baseline").alias("baseline_packets"), c("attack").alias("attack_packets"), F.round(guard("udp", "tcp"), 6).alias("udp_tcp_ratio"), F.round(safe("syn", "packets"), 6).alias("syn_total_ratio"), F.round(guard("baseline", "attack"), 6).alias("baseline_attack_ratio"), F.round(safe("bytes", "packets"), 6).alias("bytes_per_packet"),
    )


def split(rows: DataFrame, key: str, train: int = 70, validate: int = 15) -> DataFrame:
    """``rows`` with split (train, validate, test) by a fixed hash of the key, the same in every run."""
    part = F.pmod(c(key).cast("long") * 7919 + 13, F.lit(100))
    return rows.withColumn("split", F.when(part < train, "train").when(part < train + validate, "validate").otherwise("test"))


def train_multiclass(rows: DataFrame, label: str, features: tuple[str, ...], trees: int = 100, depth: int = 6, kind: str = "forest", labels: DataFrame | None = None):
    """A fitted pipeline: label index (alphabetical, of the rows or of ``labels``), assembled features, and a forest, a
    single tree, boosted trees (``trees`` rounds for each class against the others), or naive Bayes over counts."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, NaiveBayes, OneVsRest, RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    columns = {"labelCol": "label_index", "featuresCol": "features"}
    if kind == "boosted":
        learner = OneVsRest(classifier=GBTClassifier(maxIter=trees, maxDepth=depth, seed=7), **columns)
    elif kind == "tree":
        learner = DecisionTreeClassifier(maxDepth=depth, seed=7, **columns)
    elif kind == "bayes":
        learner = NaiveBayes(modelType="multinomial", smoothing=1.0, **columns)
    else:
        learner = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, **columns)
    index = StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="skip").fit(rows if labels is None else labels)
    return Pipeline(stages=[index, VectorAssembler(inputCols=list(features), outputCol="features"), learner]).fit(rows)


def save_model(model, path: str, spark) -> None:
    """The fitted pipeline, and beside it the mapping of indexes to labels as JSON."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame(list(enumerate(model.stages[0].labels)), "idx int, label string").coalesce(1).write.mode("overwrite").json(f"{path}/labels")


def load_model(path: str, spark):
    """The pipeline, and its labels in the order of their indexes."""
    from pyspark.ml import PipelineModel

    labels = spark.read.schema("idx int, label string").json(f"{path}/labels").orderBy("idx").collect()  # a row for each class
    return PipelineModel.load(f"{path}/model"), [r["label"] for r in labels]


def score_multiclass(model, rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with predicted (a label's name), confidence and probabilities (by label index); the first of equal classes wins.

    Boosted trees of one class against the others give a margin for each; their probabilities are made to sum to one.
    """
    from pyspark.ml.functions import vector_to_array

    names = F.array(*[F.lit(x) for x in model.stages[0].labels])
    seen = model.transform(rows)
    if "probability" in seen.columns:
        p = vector_to_array("probability")
    else:
        each = F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-2 * x)))
        p = F.transform(each, lambda x: x / F.aggregate(each, F.lit(0.0), lambda a, y: a + y))
    best = F.array_max("p")
    return seen.withColumn("p", p).select(*rows.columns, F.get(names, (F.array_position("p", best) - 1).cast("int")).alias("predicted"), best.alias("confidence"), c("p").alias("probabilities"))


def gated(predicted: Column, confidence: Column, benign: str = "benign", least: float = 0.75) -> Column:
    """An attack, if the model says so and is confident."""
    return (predicted != benign) & (confidence >= least)


def hybrid_decision(rule: Column, model: Column) -> Column:
    return F.when(rule & model, "CRITICAL").when(rule, "HIGH").when(model, "ANOMALY").otherwise("NONE")


def score_with(model, rows: DataFrame, features: tuple[str, ...], fallback: Callable[[DataFrame], Column]) -> DataFrame:
    """``rows`` with score: of a model with predict_proba, by Arrow batches. Without a model, and for a batch in which it fails, the fallback column."""
    ruled = rows.withColumn("score", fallback(rows))
    if model is None:
        return ruled

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            try:
                yield f.assign(score=[float(p[-1]) for p in model.predict_proba(f[list(features)])])
            except Exception as e:  # whatever a model of another library may raise
                logging.getLogger(__name__).warning("the model failed, the rules score instead: %s", e)
                yield f

    ship(rows.sparkSession)
    return ruled.mapInPandas(run, ruled.schema)


class ShareModel:
    """The simplest model of two classes: the probability of the second is one column's share of another."""

    def __init__(self, part: str, whole: str):
        self.part, self.whole = part, whole

    def predict_proba(self, rows: pd.DataFrame) -> list[tuple[float, float]]:
        return [(1 - p, p) for p in rows[self.part] / rows[self.whole]]
