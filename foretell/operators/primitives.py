"""The models on plain arrays: flat row-major vectors, as SQL functions take them."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame

import foretell
from foretell.models import gbm
from foretell.models.kernel import Kernel, standardiser
from foretell.models.tabular import Config
from foretell.plans.encode import MAX_CLASSES, MAX_FEATURES
from foretell.sources.tables import session

#: Limits of a model; the last four are those of a network, null without one.
LIMITS = ("max_features", "max_classes", "dim", "n_layers", "n_heads", "n_landmarks")


def _rows(flat, n_feat: int, what: str) -> np.ndarray:
    if n_feat <= 0:
        raise ValueError("n_feat must be > 0")
    x = np.asarray(flat, float)
    if len(x) == 0 or len(x) % n_feat:
        raise ValueError(f"{what} must hold at least one row of {n_feat} values, and whole rows")
    return x.reshape(-1, n_feat)


def _labelled(support: np.ndarray, labels) -> np.ndarray:
    y = np.asarray(labels)
    if len(y) != len(support):
        raise ValueError(f"{len(y)} labels for {len(support)} support rows")
    return y


def classify(query, support, labels, n_feat: int, n_class: int) -> list[float] | None:
    """Probabilities, n_class for each query row, one row after the other; null if an argument is null."""
    if any(a is None for a in (query, support, labels, n_feat, n_class)):
        return None
    if n_class <= 0:
        raise ValueError("n_class must be > 0")
    if n_feat > MAX_FEATURES or n_class > MAX_CLASSES:
        raise ValueError(f"at most {MAX_FEATURES} features and {MAX_CLASSES} classes")
    q, s = _rows(query, n_feat, "query"), _rows(support, n_feat, "support")
    y = _labelled(s, labels).astype(int)
    if y.min() < 0 or y.max() >= n_class:
        raise ValueError("labels must lie in 0 .. n_class - 1")
    return Kernel(s, y, n_class).probabilities(q).ravel().tolist()


def regress(query, support, labels, n_feat: int) -> list[float] | None:
    """(mean, deviation) for each query row; the deviation is that of the in-sample residuals, 0 for one support row."""
    if any(a is None for a in (query, support, labels, n_feat)):
        return None
    q, s = _rows(query, n_feat, "query"), _rows(support, n_feat, "support")
    y = _labelled(s, labels).astype(float)
    model = gbm.fit(s, y)
    sd = float(np.sqrt(((y - model.predict(s)) ** 2).sum() / (len(y) - 1))) if len(y) > 1 else 0.0
    return np.stack([model.predict(q), np.full(len(q), sd)], 1).ravel().tolist()


def classify_gated(query, support, labels, n_feat: int, n_class: int, threshold: float) -> int | None:
    """The likeliest class of one query row, or null if its probability is below the threshold."""
    if threshold is None or (p := classify(query, support, labels, n_feat, n_class)) is None:
        return None
    if len(p) != n_class:
        raise ValueError("a gated call takes one query row")
    return int(np.argmax(p)) if max(p) >= threshold else None


def similar_rows(query, support, n_feat: int, k: int) -> list[tuple[int, float]]:
    """(support index, distance) of the k rows nearest to one query, standardised by the support; ties by index."""
    if any(a is None for a in (query, support, n_feat, k)) or k <= 0:
        return []
    q, s = _rows(query, n_feat, "query"), _rows(support, n_feat, "support")
    if len(q) != 1:
        raise ValueError("similar takes one query row")
    mean, sd = standardiser(s)
    d = np.sqrt((((s - mean) / sd - (q - mean) / sd) ** 2).sum(1))
    return [(int(i), float(d[i])) for i in np.argsort(d, kind="stable")[:k]]


def version() -> str:
    return foretell.__version__


def _config() -> Config | None:
    """The in-context network's configuration, where the session names its files."""
    conf = session().conf
    weights, config = (conf.get(f"spark.foretell.{k}", None) for k in ("model", "config"))
    if not (weights and config):
        return None
    with open(config) as f:
        return Config(**{k: v for k, v in json.load(f).items() if k in Config.__dataclass_fields__})


def model_info() -> str:
    """Which models answer in this session, and where they come from."""
    c = _config()
    if c is None:
        classifier = f"Gaussian kernel over standardised rows, up to {MAX_FEATURES} features and {MAX_CLASSES} classes"
    else:
        classifier = f"in-context network of {session().conf.get('spark.foretell.model')}: " + ", ".join(f"{k} {getattr(c, k)}" for k in LIMITS)
    return f"classifier: {classifier}; regressor: {gbm.TREES} boosted trees of depth {gbm.DEPTH}"


def limits() -> tuple:
    c = _config()
    return (MAX_FEATURES, MAX_CLASSES, None, None, None, None) if c is None else tuple(getattr(c, k) for k in LIMITS)


def caps() -> DataFrame:
    """One row: the limits of the model that classifies in this session."""
    return session().createDataFrame([limits()], ", ".join(f"{k} int" for k in LIMITS))
