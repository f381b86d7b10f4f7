"""A quality classifier: regularised quadratic discriminant over text statistics.

Class means and covariances come from moments that Spark sums over all labelled
rows; covariances shrink towards the pooled one and its diagonal. The score is the
logistic of the difference of log densities, with Mahalanobis distances taken by
the Cholesky factors that each worker gets ready made.

Defined cases: a text without words has all features zero and is scored like any
other; where a class has fewer than two labelled rows, the score is the share of
label 1 (0.5 without labels); rows of `labels` with null quality or id teach
nothing; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelight.llm.langid import held_out
from duelight.llm.tables import materialise
from duelight.llm.textstats import FEATURES, features

#: Shares of the pooled covariance, and of its mean variance, in a class covariance.
POOL, RIDGE = 0.2, 0.05
D = len(FEATURES)


def moments(rows: DataFrame) -> list:
    """Per class: count, sums, and sums of products (rows of quality, x); two rows reach the driver."""
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(D)]
    products = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i in range(D) for j in range(i + 1)]
    return rows.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect()


def fit(rows: DataFrame) -> dict:
    """The model of (quality 0/1, x) rows."""
    found = {r["quality"]: r for r in moments(rows)}
    n = {k: found[k]["n"] if k in found else 0 for k in (0, 1)}
    share = n[1] / (n[0] + n[1]) if n[0] + n[1] else 0.5
    if min(n.values()) < 2:
        return {"share": share}
    mean, scatter = {}, {}
    for k in (0, 1):
        r = found[k]
        mean[k] = np.array([r[f"s{i}"] for i in range(D)]) / n[k]
        products = np.array([[r[f"p{max(i, j)}_{min(i, j)}"] for j in range(D)] for i in range(D)])
        scatter[k] = products / n[k] - np.outer(mean[k], mean[k])
    pooled = (n[0] * scatter[0] + n[1] * scatter[1]) / (n[0] + n[1])
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    model = {"share": share, "scale": scale, "classes": []}
    for k in (0, 1):
        cov = ((1 - POOL) * scatter[k] + POOL * pooled) / np.outer(scale, scale)
        cov = (1 - RIDGE) * cov + RIDGE * np.trace(cov) / D * np.eye(D) + 1e-6 * np.eye(D)
        low = np.linalg.cholesky(cov)
        constant = np.log(n[k] / (n[0] + n[1])) - np.log(np.diag(low)).sum()
        model["classes"].append((mean[k] / scale, np.linalg.inv(low), constant))
    return model


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for rows of features."""
    if "classes" not in model:
        return np.full(len(x), model["share"])
    z = x / model["scale"]
    log0, log1 = (c - 0.5 * (((z - mean) @ whiten.T) ** 2).sum(axis=1) for mean, whiten, c in model["classes"])
    return 1 / (1 + np.exp(np.clip(log0 - log1, -700, 700)))


def score(x: Column, model: dict) -> Column:
    @F.pandas_udf("double")
    def udf(rows: pd.Series) -> pd.Series:
        return pd.Series(probability(model, np.stack(rows.to_list()) if len(rows) else np.zeros((0, D))))

    return udf(x)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learned from labels outside the held-out part."""
    rows = materialise(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), features("text").alias("x")), "op9-features")
    known = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    model = fit(rows.where(~F.col("held_out")).join(known, "doc_id").select("quality", "x"))
    scored = rows.select("doc_id", "held_out", score(F.col("x"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
