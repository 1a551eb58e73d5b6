"""Predictions for a stream: unknown rows arrive, known ones are a table at rest.

The support is encoded and fitted once, when the stream starts; each micro-batch is encoded by the same projection and
scored in one narrow pass, so there is no state and no watermark. ``restart`` after the support has changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretell.models.scoring import Model
from foretell.operators.neighbors import Reference
from foretell.operators.predict import Scorer
from foretell.plans.encode import encode, kind_of, number_of, word_to_number


def encoder_of(support: DataFrame, target: str, key: list[str]):
    """(model, reference, projection): x of rows with the support's columns, by the support's vocabularies and means."""
    e = encode(support.filter(F.col(target).isNotNull()), target, key=key)
    _, x, _ = e.support()
    types = {f.name: f.dataType for f in support.schema}
    values = []
    for j, (c, kind) in enumerate(zip(e.features, e.kinds, strict=True)):
        v = F.col(f"`{c}`")
        if kind == "categorical":
            vocab = e.levels[c]
            at = F.array_position(F.array(*[F.lit(t) for t in vocab]), v)
            mode = max(range(len(vocab)), key=lambda i: ((x[:, j] == i).sum(), -i))
            values.append(F.when(v.isNull(), float(mode)).otherwise(F.coalesce(F.nullif(at, F.lit(0)) - 1, F.lit(len(vocab)))).cast("double"))
        else:
            n = word_to_number(v) if kind_of(types[c]) == "text" else number_of(v, types[c])
            values.append(F.coalesce(n, F.lit(float(x[:, j].mean()))))
    return e, F.array(*values)


def score_stream(stream: DataFrame, support: DataFrame, target: str, key: list[str]) -> DataFrame:
    """The stream's key columns with prediction, confidence, trust and ood; works on a table as well."""
    import numpy as np
    import pyarrow as pa

    e, x = encoder_of(support, target, key)
    model = Model(e)
    scorer = Scorer(model, Reference(model.x, support.sparkSession, model.n) if e.n_support >= 2 else None)
    d, names = e.n_features, ["prediction", "confidence", "trust", "ood"]
    rows = stream.select(*key, x.alias("x"))

    def each(batches):
        for b in batches:
            if b.num_rows:
                found = scorer(np.asarray(b.column(len(key)).flatten()).reshape(b.num_rows, d))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(key)], *(pa.array(found[n]) for n in names)], names=[*key, *names])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(each, f"{schema}, prediction double, confidence double, trust double, ood boolean")
