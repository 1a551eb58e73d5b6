"""Split-conformal intervals and thresholds: fit on every other labeled row, measure on the rest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretell.models.scoring import Model
from foretell.operators.predict import encoded, predictions
from foretell.plans.encode import Encoded, EncodingError


def quantile_sorted(values: np.ndarray, q: float) -> float:
    """Linear interpolation at q * (n - 1); 0 without values."""
    return float(np.quantile(values, q)) if len(values) else 0.0


def _checked(table, target, coverage: float, options: dict) -> Encoded:
    if not 0.0 <= coverage < 1.0:
        raise EncodingError("coverage must be at least 0 and below 1")
    e = encoded(table, target, **options)
    e.require_support()
    return e


def half_width(e: Encoded, coverage: float) -> float:
    """Quantile of the absolute residuals of the odd-placed labeled rows under a model of the even-placed ones."""
    _, x, y = e.support()
    model = Model(e, slice(0, None, 2))
    return quantile_sorted(np.abs(y[1::2] - model.predict(x[1::2])), coverage)


def conformal_regress(table, target: str | None = None, coverage: float = 0.9, model: Model | None = None, **options) -> DataFrame:
    """(row_id, prediction, lo, hi) of each row whose target is null, by the full model and the half-split's quantile."""
    e = _checked(table, target, coverage, options)
    if e.is_classification():
        raise EncodingError(f'"{e.target}" looks categorical; conformal_threshold is for classes')
    if e.n_support < 4:
        raise EncodingError("need >= 4 labeled rows for split-conformal")
    q = half_width(e, coverage)
    out = predictions(e, model or Model(e), e.queries(), rounded=False)
    return out.select("row_id", "prediction", (F.col("prediction") - q).alias("lo"), (F.col("prediction") + q).alias("hi"))


def conformal_threshold(table, target: str | None = None, coverage: float = 0.9, **options) -> float:
    """Probability from which on a class belongs to the prediction set at this coverage."""
    e = _checked(table, target, coverage, options)
    if not e.is_classification():
        raise EncodingError("conformal_threshold is for classification targets")
    if e.n_support < 4:
        raise EncodingError("need >= 4 labeled rows for split-conformal")
    _, x, y = e.support()
    model = Model(e, slice(0, None, 2))
    p = model.probabilities(x[1::2])
    miss = 1.0 - p[np.arange(len(p)), np.searchsorted(model.values, y[1::2])]
    return float(np.clip(1.0 - quantile_sorted(miss, coverage), 0.0, 1.0))
