"""Linear probes and PCA on Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def probe_input(vec: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """(features, label, train): split by a hash of the key, so it is the same in every run."""
    j = vec.join(labels, keys)
    return j.select(array_to_vector("vec").alias("features"), F.col("label").cast("double").alias("label"), (F.pmod(F.xxhash64(*keys), F.lit(5)) < 4).alias("train"))


def linear_probe(data: DataFrame, max_iter: int = 50, reg: float = 0.01) -> DataFrame:
    """Held-out accuracy of a logistic probe, plus AUC and average precision when the label is binary."""
    train, test = data.filter("train"), data.filter("not train")
    classes = data.agg(F.countDistinct("label").alias("k")).first()["k"]
    pred = LogisticRegression(maxIter=max_iter, regParam=reg).fit(train).transform(test)
    out = {"accuracy": MulticlassClassificationEvaluator(metricName="accuracy").evaluate(pred)}
    if classes == 2:
        out["auc"] = BinaryClassificationEvaluator(metricName="areaUnderROC").evaluate(pred)
        out["average_precision"] = BinaryClassificationEvaluator(metricName="areaUnderPR").evaluate(pred)
    return data.sparkSession.createDataFrame(list(out.items()), "name string, value double")


def pca(df: DataFrame, k: int, col: str = "vec") -> DataFrame:
    """Adds ``pc``: the first ``k`` principal coordinates of ``col``."""
    d = df.withColumn("_f", array_to_vector(col))
    model = PCA(k=k, inputCol="_f", outputCol="_p").fit(d)
    return model.transform(d).withColumn("pc", vector_to_array("_p")).drop("_f", "_p")
