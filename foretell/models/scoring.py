"""Scoring rows of an encoded table with a fitted model: the support is broadcast, the rows stay where they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foretell.models import gbm
from foretell.models.kernel import Kernel
from foretell.models.tabular import load
from foretell.plans.encode import MAX_FEATURES, Encoded, EncodingError


#: Pairs of rows that the driver compares by itself; more are compared in tasks, with the same result.
LOCAL_PAIRS = 20_000_000


def in_tasks(spark: SparkSession, x: np.ndarray, f: Callable[[np.ndarray], np.ndarray], others: int) -> np.ndarray:
    """``f`` of the rows of ``x`` (bounded by the sample that models are fitted on), each of which it compares with ``others`` rows."""
    if len(x) * others <= LOCAL_PAIRS:
        return f(x)
    sent = spark.sparkContext.broadcast((f, x))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, rows = sent.value
        for b in batches:
            if b.num_rows:
                found = g(rows[b.column(0).to_numpy()]).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(found), pa.list_(pa.float64()))], names=["id", "v"])

    out = spark.range(0, len(x), 1, -(-len(x) // 512)).mapInArrow(each, "id long, v array<double>").toArrow().sort_by("id")
    v = np.asarray(out.column("v").combine_chunks().flatten()).reshape(len(x), -1)
    return v[:, 0] if v.shape[1] == 1 else v


class Model:
    """A classifier or regressor of an encoded table; fitting happens once and is shared by what is asked of it."""

    def __init__(self, e: Encoded, rows: slice | None = None):
        """``rows``: which of the support rows, in order of row_id; all if not given. The model keeps their vectors in ``x``, with
        how many rows each stands for in ``n`` (None: one)."""
        e.require_support()
        self.e = e
        self.classify = e.is_classification()
        sums = rows is None and e.many and not self.classify
        if sums:
            self.x, total, self.n, unit = e.summed()
        elif rows is None:
            self.x, y, self.n = e.grouped()
        else:
            self.x, y, self.n = e.support()[1][rows], e.support()[2][rows], None
        if self.classify:
            if e.n_features > MAX_FEATURES:
                raise EncodingError(f"{e.n_features} features; the classifier takes {MAX_FEATURES} at most")
            self.values = np.array(e.classes())
            labels = np.searchsorted(self.values, y)
            conf = e.df.sparkSession.conf
            weights, config = (conf.get(f"spark.foretell.{k}", None) for k in ("model", "config"))
            if weights and config:  # an in-context network, where its files are given
                each = 1 if self.n is None else self.n
                self.fitted = load(weights, config).read(np.repeat(self.x, each, 0), np.repeat(labels, each), len(self.values))
            else:
                self.fitted = Kernel(self.x, labels, len(self.values), self.n)
        else:
            self.fitted = gbm.fit_sums(self.x, total, self.n, unit) if sums else gbm.fit(self.x, y)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return in_tasks(self.e.df.sparkSession, x, self.fitted.probabilities, len(self.x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Predicted value: the likeliest class, or the regression's mean."""
        return self.values[self.probabilities(x).argmax(1)] if self.classify else self.fitted.predict(x)


def map_vectors(df: DataFrame, f: Callable[..., dict[str, np.ndarray]], schema: str, d: int, with_y: bool = False) -> DataFrame:
    """Columns computed from x (and y), appended to row_id; ``f`` gets (rows, d) arrays, a batch at a time. Only these are read."""
    sent = df.sparkSession.sparkContext.broadcast(f)
    names = [c.split()[0] for c in schema.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(1).flatten()).reshape(b.num_rows, d)
                found = sent.value(x, b.column(2).to_numpy(zero_copy_only=False)) if with_y else sent.value(x)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(found[n]) for n in names)], names=["row_id", *names])

    return df.select("row_id", "x", *["y"] * with_y).mapInArrow(each, "row_id long, " + schema)
