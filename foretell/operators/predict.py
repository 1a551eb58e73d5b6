"""Task detection, prediction of unknown targets, imputation, anomaly scores and trust."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretell.functions.numbers import decimal_places, round_to
from foretell.models.scoring import Model, map_vectors
from foretell.operators.neighbors import Reference
from foretell.plans.encode import Encoded, EncodingError, encode
from foretell.sources.shared import written

PREDICTION = "row_id long, prediction double, confidence double, task string"


def encoded(table, target: str | None = None, **options) -> Encoded:
    """An encoded table, from anything that resolves to one; an Encoded is passed on."""
    return table if isinstance(table, Encoded) else encode(table, target, **options)


def detect_task(table, target: str | None = None, **options) -> str:
    e = encoded(table, target, **options)
    e.require_support()
    if e.is_classification():
        return f"classify ({len(e.classes())} classes, {e.n_support} labeled rows, {e.n_features} features)"
    return f"regress ({e.n_support} labeled rows, {e.n_features} features)"


def target_precision(e: Encoded) -> int:
    """Decimals that show all known targets; 0 for whole numbers."""
    if e.target_is_int:
        return 0
    return e.df.filter("support").agg(F.max(decimal_places(F.col("y")))).first()[0] or 0


def predictions(e: Encoded, model: Model, rows: DataFrame, ref: Reference | None = None, rounded: bool = True) -> DataFrame:
    """(row_id, prediction, confidence, trust, ood, task) of rows, in one pass over their vectors."""
    out = map_vectors(rows, Scorer(model, ref), "prediction double, confidence double, trust double, ood boolean", e.n_features)
    if not model.classify and rounded:
        out = out.withColumn("prediction", round_to(F.col("prediction"), target_precision(e)))
    return out.withColumn("task", F.lit("classify" if model.classify else "regress"))


class Scorer:
    """What the executors need of a model and a reference, without the table behind them."""

    def __init__(self, model: Model, ref: Reference | None):
        self.fitted, self.ref = model.fitted, ref
        self.values = model.values if model.classify else None

    def __call__(self, x: np.ndarray) -> dict:
        trust, ood = self.ref.trust(x) if self.ref else (np.full(len(x), 0.5), np.zeros(len(x), bool))
        if self.values is None:
            return {"prediction": self.fitted.predict(x), "confidence": trust, "trust": trust, "ood": ood}
        p = self.fitted.probabilities(x)
        return {"prediction": self.values[p.argmax(1)], "confidence": p.max(1), "trust": trust, "ood": ood}


def automl(table, target: str | None = None, **options) -> DataFrame:
    """(row_id, prediction, confidence, task) of each row whose target is null.

    Classes are predicted with the share of the likeliest as confidence; a regression is rounded to the target's decimals,
    its confidence being the trust in the row (0.5 with fewer than two support rows).
    """
    e = encoded(table, target, **options)
    model = Model(e)
    ref = Reference(model.x, e.df.sparkSession, model.n) if not model.classify and e.n_support >= 2 else None
    return predictions(e, model, e.queries(), ref).select("row_id", "prediction", "confidence", "task")


def impute(table, target: str | None = None, **options) -> DataFrame:
    """(row_id, imputed): the predictions of :func:`automl` alone."""
    e = encoded(table, target, **options)
    return predictions(e, Model(e), e.queries()).select("row_id", F.col("prediction").alias("imputed"))


def predict_trust(table, target: str | None = None, **options) -> DataFrame:
    """(row_id, prediction, confidence, trust, ood, task) of each row whose target is null; regressions are not rounded."""
    e = encoded(table, target, **options)
    e.require_support()
    if e.n_support < 2:
        raise EncodingError("need >= 2 labeled rows for a distance reference")
    model = Model(e)
    return predictions(e, model, e.queries(), Reference(model.x, e.df.sparkSession, model.n), rounded=False).select("row_id", "prediction", "confidence", "trust", "ood", "task")


def anomaly(table, target: str | None = None, model: Model | None = None, **options) -> DataFrame:
    """(row_id, score, is_outlier) of each labeled row: 1 - P(its class), over 0.5; or the z-score of its residual, over 2. Rows are
    scored where they are, whether the model was fitted on them or not."""
    e = encoded(table, target, **options)
    model = model or Model(e)
    rows = e.df.filter("support")
    if model.classify:
        out = map_vectors(rows, Miss(model), "score double", e.n_features, with_y=True)
        return out.withColumn("is_outlier", F.col("score") > 0.5)
    # Residuals are written once: their mean and deviation are one row, and the scores a projection.
    held = written(map_vectors(rows, Miss(model), "residual double", e.n_features, with_y=True), "residuals")
    st = held.agg(F.avg("residual").alias("m"), F.stddev_pop("residual").alias("s")).first()
    score = (F.col("residual") - F.lit(st["m"])) / F.lit(max(st["s"], 1e-9))
    return held.select("row_id", score.alias("score"), (score > 2.0).alias("is_outlier"))


class Miss:
    """How far a model is from known targets: 1 less the probability of the class, or the absolute residual."""

    def __init__(self, model: Model):
        self.fitted, self.values = model.fitted, model.values if model.classify else None

    def __call__(self, x: np.ndarray, y: np.ndarray) -> dict:
        if self.values is None:
            return {"residual": np.abs(y - self.fitted.predict(x))}
        p = self.fitted.probabilities(x)
        return {"score": 1.0 - p[np.arange(len(p)), np.searchsorted(self.values, y)]}
