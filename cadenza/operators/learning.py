"""Learning from collected labels: silver labels by status, a gate for training targets, and a linear specialist."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, OneVsRestModel
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def silver_status(answers: DataFrame, taxonomy: list[str]) -> DataFrame:
    """answers (id, partition, label, score, error) with a status: only rows of `train` whose label is known and whose score is 0 to 1 are `labelled`."""
    status = (
        F.when(F.col("partition") != "train", "not_attempted").when(F.col("error").isNotNull(), "failed").when(F.col("label").isNull(), "abstained")
        .when(~F.col("label").isin(taxonomy), "failed").when(F.coalesce(F.col("score").between(0, 1) & ~F.isnan("score"), F.lit(False)), "labelled").otherwise("failed")
    )
    return answers.withColumn("status", status)


def gate_targets(targets: DataFrame) -> list[str]:
    """What forbids training on targets (id, label, teacher, prompt); nothing, if they may be trained on."""
    r = targets.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.countDistinct("label").alias("labels"), F.countDistinct("teacher").alias("teachers"), F.countDistinct("prompt").alias("prompts")).first()
    told = [(r["n"] < 1, "no example"), (r["labels"] < 2, "fewer than two classes"), (r["teachers"] > 1, "several teachers"), (r["prompts"] > 1, "several prompts"), (r["ids"] < r["n"], "repeated ids")]
    return [what for bad, what in told if bad]


def fit_specialist(rows: DataFrame, penalty: float = 1.0) -> PipelineModel:
    """Standardised features and multinomial logistic regression on rows (features array<double>, label string)."""
    n = rows.count()
    stages = [
        StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc"), StandardScaler(inputCol="v", outputCol="x", withMean=True, withStd=True),
        LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=1 / (penalty * max(n, 1)), maxIter=1000, standardization=False),
    ]
    return Pipeline(stages=stages).fit(rows.withColumn("v", array_to_vector("features")))


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows (id, features) with the likeliest label and its probability."""
    names = F.array(*[F.lit(x) for x in model.stages[0].labels])
    x = rows.withColumn("v", array_to_vector("features"))
    for stage in model.stages[1:]:
        x = stage.transform(x)
    return x.select("id", F.element_at(names, F.col("prediction").cast("int") + 1).alias("said"), F.array_max(vector_to_array("probability")).alias("score"))


@dataclass
class Margins:
    """A fitted margin machine: the standardisation and the classifier, and the random features between them."""

    scale: PipelineModel
    machine: OneVsRestModel
    wide: int
    features: int
    seed: int

    def lifted(self, rows: DataFrame) -> DataFrame:
        """rows (features, ...) with z, their random Fourier features."""
        return _lifted(self.scale.transform(rows.withColumn("v", array_to_vector("features"))), self.wide, self.features, self.seed)

    def predict(self, rows: DataFrame) -> DataFrame:
        """(id, said) of rows (id, features)."""
        names = F.array(*[F.lit(x) for x in self.scale.stages[0].labels])
        x = self.scale.stages[1].transform(rows.select("id", array_to_vector("features").alias("v")))
        return self.machine.transform(_lifted(x, self.wide, self.features, self.seed)).select("id", F.element_at(names, F.col("prediction").cast("int") + 1).alias("said"))


def _lifted(x: DataFrame, wide: int, features: int, seed: int) -> DataFrame:
    """x (x, ...) with z: features whose products are near exp(-|a - b|^2 / wide), the kernel of width 1 / wide, as random waves have it for normal frequencies and even phases."""
    rng = np.random.default_rng(seed)
    waves, phases = rng.normal(scale=np.sqrt(2.0 / wide), size=(wide, features)), rng.uniform(0, 2 * np.pi, features)

    @F.pandas_udf("array<double>")
    def lift(v: pd.Series) -> pd.Series:
        z = np.sqrt(2.0 / features) * np.cos(np.stack(v.to_numpy()) @ waves + phases) if len(v) else np.empty((0, features))
        return pd.Series(list(z))

    return x.withColumn("z", array_to_vector(lift(vector_to_array("x"))))


def fit_margins(rows: DataFrame, cost: float = 10.0, features: int = 512, seed: int = 17) -> Margins:
    """A machine of least hinge loss with a radial kernel on standardised features of rows (features array<double>, label string), one class against the rest, each class weighed by how rare it is.

    The kernel exp(-|a - b|^2 / d), d being the features' number, is approached by random Fourier features, so the machine is a linear one that Spark fits, and no matrix of rows by rows arises. The more of them, the nearer: the error of
    a product falls as one over the root of their number."""
    counts = rows.groupBy("label").agg(F.count("*").alias("c"))
    n, k, wide = (*counts.agg(F.sum("c"), F.count("*")).first(), rows.select(F.size("features")).first()[0])
    stages = [StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc"), StandardScaler(inputCol="v", outputCol="x", withMean=True, withStd=True)]
    weighed = rows.join(F.broadcast(counts), "label").withColumn("w", F.lit(n / k) / F.col("c")).withColumn("v", array_to_vector("features"))
    scale = Pipeline(stages=stages).fit(weighed)
    lifted = _lifted(scale.transform(weighed), wide, features, seed)
    svc = LinearSVC(featuresCol="z", labelCol="y", weightCol="w", regParam=1 / (cost * n), maxIter=30, standardization=False)
    return Margins(scale, OneVsRest(classifier=svc, featuresCol="z", labelCol="y", weightCol="w", parallelism=4).fit(lifted), wide, features, seed)


def arrival_prefixes(rows: DataFrame, held_out: DataFrame, sizes: list[int]) -> DataFrame:
    """(size, n, correct): specialists trained on nested prefixes, by arrival, of rows (id, arrival, features, label), and scored on held-out rows."""
    out = None
    for size in sizes:
        model = fit_specialist(rows.filter(F.col("arrival") <= size).select("features", "label"))
        said = predict(model, held_out).join(held_out.select("id", "label"), "id")
        scored = said.agg(F.count("*").alias("n"), F.count_if(F.col("said") == F.col("label")).alias("correct")).select(F.lit(size).alias("size"), "n", "correct")
        out = scored if out is None else out.unionByName(scored)
    return out
