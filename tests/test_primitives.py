import math

import pytest
from pyspark.sql import functions as F
from tables import BOTTLES, bottles

from foretell.functions import numbers
from foretell.operators import primitives as p
from foretell.operators.neighbors import similar
from foretell.operators.predict import automl
from foretell.sql import register

SUPPORT, LABELS = [v for r in BOTTLES[:6] for v in r[:3]], [r[3] for r in BOTTLES[:6]]
ASKED = [*BOTTLES[12][:3]]


def test_classify_and_gate():
    out = p.classify([*ASKED, *BOTTLES[13][:3]], SUPPORT, LABELS, 3, 3)
    assert len(out) == 6 and abs(sum(out[:3]) - 1) < 1e-9 and out.index(max(out[:3])) == 0
    assert p.classify_gated(ASKED, SUPPORT, LABELS, 3, 3, 0.99) is None and p.classify_gated(ASKED, SUPPORT, LABELS, 3, 3, 0.3) == 0
    assert p.classify(None, SUPPORT, LABELS, 3, 3) is None
    for bad in (([1.0], SUPPORT, LABELS, 3, 3), ([], SUPPORT, LABELS, 3, 3), ([1.0] * 3, SUPPORT, LABELS[:2], 3, 3), ([1.0] * 3, SUPPORT, LABELS, 0, 3), ([1.0] * 3, SUPPORT, LABELS, 3, 0)):
        with pytest.raises(ValueError):
            p.classify(*bad)


def test_64_dimensions():
    import numpy as np

    rng = np.random.default_rng(0)
    sign = np.where(np.arange(64) % 2, 1.0, -1.0)
    s = [(sign if i % 2 else -sign) + rng.normal(0, 0.1, 64) for i in range(8)]
    out = np.array(p.classify(np.concatenate(s[:6]).tolist(), np.concatenate(s).tolist(), [i % 2 for i in range(8)], 64, 2)).reshape(-1, 2)
    assert np.allclose(out.sum(1), 1) and (out.argmax(1) == [0, 1] * 3).all()


def test_table_path_agrees_with_arrays(spark):
    t = bottles(spark)
    rows = sorted(t.collect())
    s = [v for r in rows if r.sort is not None for v in r[1:4]]
    y = [r.sort for r in rows if r.sort is not None]
    got = {r.row_id: r for r in automl(t, "sort", key="id").collect()}
    for r in rows[12:]:
        probs = p.classify(list(r[1:4]), s, y, 3, 3)
        assert got[r.id].prediction == probs.index(max(probs)) and abs(got[r.id].confidence - max(probs)) < 1e-9


def test_regress():
    out = p.regress([1.0, 4.0], [1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 6.0, 8.0], 1)
    assert out[1] == out[3] > 0 and out[0] < out[2]
    assert p.regress([1.0], [1.0], [3.0], 1) == [3.0, 0.0]


def test_similar(spark):
    assert p.similar_rows(SUPPORT[6:9], SUPPORT, 3, 1) == [(2, 0.0)] and p.similar_rows(ASKED, SUPPORT, 3, 0) == []
    t = spark.createDataFrame([(i, SUPPORT[3 * i : 3 * i + 3]) for i in range(6)], "id long, x array<double>")
    q = spark.createDataFrame([(0, ASKED)], "id long, x array<double>")
    want = p.similar_rows(ASKED, SUPPORT, 3, 4)
    got = [(r.support_id, r.distance) for r in similar(t, q, 4).orderBy("rank").collect()]
    assert [g[0] for g in got] == [w[0] for w in want] and all(abs(a[1] - b[1]) < 1e-9 for a, b in zip(got, want, strict=True))
    assert similar(t, q, 0).count() == 0
    ties = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(40)], "id long, x array<double>").repartition(4)
    got = [r.support_id for r in similar(ties, spark.createDataFrame([(0, [0.0, 1.0])], "id long, x array<double>"), 16).orderBy("rank").collect()]
    assert got == [*range(0, 40, 3), 1, 4]


def test_argmax_confidence_and_sql(spark):
    register(spark)
    nan = float("nan")
    rows = [([0.1, 0.7, 0.2],), ([0.5, 0.5],), ([nan, 0.2, 0.9],), ([],), (None,), ([nan],)]
    t = spark.createDataFrame(rows, "v array<double>")
    got = [tuple(r) for r in t.select(numbers.argmax(F.col("v")), numbers.confidence(F.col("v"))).collect()]
    assert got == [(1, 0.7), (0, 0.5), (2, 0.9), (0, -math.inf), (None, None), (0, -math.inf)]
    t.createOrReplaceTempView("vs")
    assert [tuple(r) for r in spark.sql("select ft_argmax(v), ft_confidence(v) from vs").collect()] == got
    assert spark.sql("select * from ft_caps()").first()["max_features"] == 100 and spark.sql("select ft_version()").first()[0]
    assert spark.sql("select ft_model_info()").first()[0].startswith("classifier")
    s, y = "array(0D,0D,0.1D,0.1D,5D,5D,5.1D,4.9D)", "array(0,0,1,1)"
    r = spark.sql(f"select ft_classify_gated(array(0.2D,0D),{s},{y},2,2,0.5) g, ft_regress(array(1D),array(1D,2D),array(1D,2D),1) r").first()
    assert r.g == 0 and len(r.r) == 2
    assert spark.sql(f"select support_idx from ft_similar(array(5D,5D),{s},2,2)").count() == 2


@pytest.mark.parametrize("v,d", [(1.0, 0), (1.5, 1), (-2.25, 2), (1 / 3, 6), (1e12 + 0.5, 0), (float("inf"), 0)])
def test_decimals(spark, v, d):
    assert spark.createDataFrame([(v,)], "v double").select(numbers.decimal_places(F.col("v"))).first()[0] == d


def test_rounding_and_quantile(spark):
    t = spark.createDataFrame([(2.5,), (-2.5,), (0.125,)], "v double")
    assert [r[0] for r in t.select(numbers.round_to(F.col("v"), 0)).collect()] == [3.0, -3.0, 0.0]
    assert t.select(numbers.quantile(F.col("v"), 0.5)).first()[0] == 0.125
    assert t.filter("v > 9").select(numbers.quantile(F.col("v"), 0.5)).first()[0] == 0.0
