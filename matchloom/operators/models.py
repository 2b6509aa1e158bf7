"""Pair ranker, reranking, fusion of scores, calibration, threshold and decision."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .evaluation import f05

#: S1 texts and candidate texts to scores before the sigmoid.
Scorer = Callable[[pd.Series, pd.Series], pd.Series]


class Ranker:
    """Gradient-boosted trees on pair features. Rows of label 1 weigh negatives / positives if balanced."""

    def __init__(self, features: list[str], trees: int = 40, depth: int = 5, rate: float = 0.1, balanced: bool = True, seed: int = 42) -> None:
        self.features, self.trees, self.depth, self.rate, self.balanced, self.seed = sorted(features), trees, depth, rate, balanced, seed
        self.model: GBTClassificationModel | None = None

    def _x(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.features, outputCol="_x", handleInvalid="keep").transform(df)

    def fit(self, train: DataFrame, validation: DataFrame | None = None) -> "Ranker":
        """validation: rows on which training stops when it no longer helps."""
        n = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
        weight = n.get(0, 0) / max(n.get(1, 0), 1) if self.balanced else 1.0
        rows = train.withColumn("_v", F.lit(False))
        gbt = GBTClassifier(featuresCol="_x", labelCol="label", weightCol="_w", maxIter=self.trees, maxDepth=self.depth, stepSize=self.rate, seed=self.seed)
        if validation is not None:
            rows = rows.unionByName(validation.withColumn("_v", F.lit(True)), allowMissingColumns=True)
            gbt = gbt.setValidationIndicatorCol("_v")
        self.model = gbt.fit(self._x(rows.withColumn("label", F.col("label").cast("double")).withColumn("_w", F.when(F.col("label") == 1, weight).otherwise(1.0))))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds score, the probability of a match."""
        out = self.model.transform(self._x(df))
        return out.withColumn("score", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")

    def importance(self) -> list[tuple[str, float]]:
        return sorted(zip(self.features, map(float, self.model.featureImportances.toArray())), key=lambda x: (-x[1], x[0]))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> "Ranker":
        self.model = GBTClassificationModel.load(path)
        return self


def ambiguous(scored: DataFrame, low: float = 0.3, high: float = 0.8, margin: float = 0.15, per_row: int = 10, batch: int = 50, fraction: float = 0.01, left: int = 50_000) -> DataFrame:
    """Pairs worth reranking: of each row's best per_row those within the band, or over low and close to the
    row's best; of all these the nearest to 0.5, within the budget (batch, fraction of the pairs, left)."""
    budget = min(batch, max(1, int(scored.count() * fraction)), max(0, left))
    w = Window.partitionBy("s1_id")
    x = scored.withColumn("_n", F.row_number().over(w.orderBy(F.desc("score"), "candidate_id"))).withColumn("_top", F.max("score").over(w)).withColumn("_k", F.count("*").over(w)).where(F.col("_n") <= per_row)
    s = F.col("score")
    x = x.where(s.between(low, high) | ((F.col("_k") >= 2) & (s > low) & (F.col("_top") - s < margin)))
    return x.orderBy(F.abs(s - 0.5), "s1_id", "candidate_id").limit(budget).drop("_n", "_top", "_k")


def rerank(pairs: DataFrame, texts: DataFrame, scorer: Scorer) -> DataFrame:
    """Adds ce_score, the sigmoid of scorer(S1 text, candidate text). texts: entity_id, record_text."""

    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series(1 / (1 + np.exp(-scorer(a, b).to_numpy(dtype=float))))

    a = texts.select(F.col("entity_id").alias("s1_id"), F.col("record_text").alias("_a"))
    b = texts.select(F.col("entity_id").alias("candidate_id"), F.col("record_text").alias("_b"))
    return pairs.join(a, "s1_id").join(b, "candidate_id").withColumn("ce_score", score("_a", "_b")).drop("_a", "_b")


def fuse(scored: DataFrame, reranked: DataFrame, ranker: float = 0.4, cross: float = 0.6) -> DataFrame:
    """score becomes the weighted sum where there is a ce_score."""
    c = reranked.select("s1_id", "candidate_id", F.col("ce_score").alias("_c"))
    return scored.join(c, ["s1_id", "candidate_id"], "left").withColumn("score", F.when(F.col("_c").isNull(), F.col("score")).otherwise(ranker * F.col("score") + cross * F.col("_c"))).drop("_c")


def fusion_model(features: list[str]) -> Ranker:
    """Learned fusion: a small ranker over scores, votes and the like."""
    return Ranker(features, trees=20, depth=3)


class Calibrator:
    """Isotonic or Platt calibration of score; unfitted, it changes nothing."""

    def __init__(self, method: str = "isotonic") -> None:
        self.method, self.model = method, None

    def fit(self, scored: DataFrame) -> "Calibrator":
        rows = scored.select(F.col("score"), F.col("label").cast("double").alias("label"))
        if self.method == "isotonic":
            self.model = IsotonicRegression(featuresCol="score", labelCol="label").fit(rows)
        else:
            self.model = LogisticRegression(featuresCol="_x").fit(VectorAssembler(inputCols=["score"], outputCol="_x").transform(rows))
        return self

    def apply(self, scored: DataFrame) -> DataFrame:
        if self.model is None:
            return scored
        if self.method == "isotonic":
            out = self.model.transform(scored)
            return out.withColumn("score", F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0))).drop("prediction")
        out = self.model.transform(VectorAssembler(inputCols=["score"], outputCol="_x").transform(scored))
        return out.withColumn("score", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> "Calibrator":
        self.model = (IsotonicRegressionModel if self.method == "isotonic" else LogisticRegressionModel).load(path)
        return self


def grid(start: float = 0.30, stop: float = 0.95, step: float = 0.01) -> list[float]:
    """start, start + step, ..., ending before stop + step, as evenly spaced floats."""
    import numpy as np

    return [float(t) for t in np.arange(start, stop + step, step)]


def threshold_curve(scored: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, macro_f05). A pair counts for every threshold up to its score, so each row's counts by the
    largest threshold reached, summed from above, are those of every threshold: no pair is repeated."""
    ts = sorted(thresholds)
    n = F.size(F.filter(F.array(*(F.lit(t) for t in ts)), lambda t: F.col("score") >= t))
    t = truth.select("s1_id", F.array_distinct("matches").alias("matches"))
    hit = F.array_contains("matches", F.col("candidate_id"))
    reached = scored.select("s1_id", "candidate_id", n.alias("n")).groupBy("s1_id", "candidate_id").agg(F.max("n").alias("n")).where("n > 0")
    per = t.join(reached, "s1_id", "left").groupBy("s1_id", "n").agg(F.sum(hit.cast("int")).alias("tp"), F.count("candidate_id").alias("predicted"), F.first(F.size("matches")).alias("actual"))
    # a row an entity: its counts by n, then at each threshold the sums over larger n
    own = per.groupBy("s1_id").agg(F.first("actual").alias("actual"), F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("tp", F.lit(0)).alias("tp"), "predicted")).alias("c"))
    x = own.select("actual", "c", F.explode(F.array(*(F.struct(F.lit(i + 1).alias("i"), F.lit(v).alias("threshold")) for i, v in enumerate(ts)))).alias("t"))
    upto = lambda f: F.aggregate("c", F.lit(0).cast("long"), lambda a, e: a + F.when(e["n"] >= F.col("t.i"), e[f].cast("long")).otherwise(F.lit(0).cast("long")))
    return x.select("t.threshold", f05(upto("tp"), upto("predicted"), F.col("actual")).alias("f")).groupBy("threshold").agg(F.avg("f").alias("macro_f05"))


def best_threshold(scored: DataFrame, truth: DataFrame, thresholds: list[float] | None = None) -> tuple[float, float]:
    """(threshold, macro F0.5): the lowest of the best."""
    rows = threshold_curve(scored, truth, thresholds or grid()).collect()
    if not rows:
        return 0.5, -1.0
    best = min(rows, key=lambda r: (-r.macro_f05, r.threshold))
    return best.threshold, best.macro_f05


def decide(scored: DataFrame, threshold: float) -> DataFrame:
    """Pairs of the threshold or more: none, one or many a row."""
    return scored.where(F.col("score") >= threshold)
