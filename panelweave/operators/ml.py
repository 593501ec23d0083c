"""Model fits by fold: distributed classifiers, small per-entity models, calibrators and stackers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.scalar import logit


def classifier(kind: str, *, label: str, weight: str | None = None, seed: int = 7, **params):
    """A pyspark.ml classifier by name: boosted, forest or logistic."""
    made = {"boosted": GBTClassifier, "forest": RandomForestClassifier, "logistic": LogisticRegression}[kind](labelCol=label, featuresCol="features", **params)
    if weight:
        made = made.setWeightCol(weight)
    return made.setSeed(seed) if kind != "logistic" else made


def fit_fold(df: DataFrame, features: Sequence[str], *, kind: str = "logistic", label: str = "target", weight: str | None = None, **params):
    """A pipeline (median imputing, assembling, classifier) fitted on df."""
    filled = [f"__{f}" for f in features]
    stages = [Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features"), classifier(kind, label=label, weight=weight, **params)]
    return Pipeline(stages=stages).fit(df)


def score(model, df: DataFrame, name: str = "p") -> DataFrame:
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.select(*df.columns, name)


def forward_scores(df: DataFrame, features: Sequence[str], *, fold: str = "fold_id", label: str = "target", first: int = 2, last: int = 5, name: str = "p", **fit) -> DataFrame:
    """Each fold scored by a model of the folds before it. Folds are few; each fit is a distributed job."""
    parts = [score(fit_fold(df.filter(F.col(fold) < k), features, label=label, **fit), df.filter(F.col(fold) == k), name) for k in range(first, last + 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def entity_logistic(df: DataFrame, features: Sequence[str], *, entity: str = "ticker", fold: str = "fold_id", label: str = "target", row: str = "row_id", first: int = 2, ridge: float = 1.0) -> DataFrame:
    """(row, p): a small ridge logistic per entity, forward only: rows of a fold are scored by the entity's earlier folds. One entity's history fits a task."""
    cols = [entity, fold, label, row, *features]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k in sorted(x for x in pdf[fold].unique() if x >= first):
            a, b = pdf[pdf[fold] < k], pdf[pdf[fold] == k]
            y = a[label].to_numpy(float)
            if len(a) < 8 or y.min() == y.max():
                continue
            mean, std = a[features].mean(), a[features].std(ddof=0).replace(0, 1)
            x = np.column_stack([np.ones(len(a)), ((a[features] - mean) / std).fillna(0)])
            w = np.zeros(x.shape[1])
            for _ in range(25):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                g = x.T @ (p - y) + ridge * w
                h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
                w = w - np.linalg.solve(h, g)
            z = np.column_stack([np.ones(len(b)), ((b[features] - mean) / std).fillna(0)])
            out.append(pd.DataFrame({row: b[row].to_numpy(), "p": 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))}))
        return pd.concat(out) if out else pd.DataFrame({row: pd.Series(dtype="int64"), "p": pd.Series(dtype="float64")})

    features = list(features)
    return df.select(*cols).groupBy(entity).applyInPandas(fit, f"{row} long, p double")


def calibrate(df: DataFrame, raw: str, *, label: str = "target", time: str = "date", share: float = 0.7) -> tuple[str, object]:
    """Identity, Platt or isotonic by the Brier score on the later dates, refitted on all rows: (name, model)."""
    cut = df.select(time).distinct().agg(F.percentile_approx(F.unix_date(time), share)).first()[0]
    early, late = df.filter(F.unix_date(time) <= cut), df.filter(F.unix_date(time) > cut)

    def fit(name: str, rows: DataFrame):
        if name == "platt":
            x = VectorAssembler(inputCols=["__x"], outputCol="features")
            return Pipeline(stages=[x, LogisticRegression(labelCol=label, featuresCol="features")]).fit(rows.withColumn("__x", logit(F.col(raw))))
        return IsotonicRegression(labelCol=label, featuresCol=raw).fit(rows.withColumn(label, F.col(label).cast("double"))) if name == "isotonic" else None

    brier = {}
    for name in ("identity", "platt", "isotonic"):
        out = apply_calibrator((name, fit(name, early)), late, raw, "__p")
        brier[name] = out.agg(F.avg((F.col("__p") - F.col(label)) ** 2)).first()[0]
    best = min(brier, key=lambda k: (brier[k] is None, brier[k]))
    return best, fit(best, df)


def apply_calibrator(calibrator: tuple[str, object], df: DataFrame, raw: str, name: str) -> DataFrame:
    kind, model = calibrator
    if kind == "identity":
        return df.withColumn(name, F.col(raw))
    if kind == "platt":
        return score(model, df.withColumn("__x", logit(F.col(raw))), name).drop("__x")
    return model.transform(df).withColumnRenamed("prediction", name)


def nonnegative_stack(df: DataFrame, scores: Sequence[str], *, label: str = "target"):
    """Logistic stacker of logits whose weights can't be negative."""
    from pyspark.ml.linalg import DenseMatrix

    x = df.withColumns({f"__l{i}": logit(F.col(c)) for i, c in enumerate(scores)})
    stages = [VectorAssembler(inputCols=[f"__l{i}" for i in range(len(scores))], outputCol="features"), LogisticRegression(labelCol=label, featuresCol="features", lowerBoundsOnCoefficients=DenseMatrix(1, len(scores), [0.0] * len(scores)))]
    return Pipeline(stages=stages).fit(x)
