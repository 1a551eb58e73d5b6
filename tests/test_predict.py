import pytest
from pyspark.sql import functions as F
from tables import ABY, FAR, MESSY, bottles, frame, plane, ropes, saddle

from foretell.operators.conformal import conformal_regress, conformal_threshold
from foretell.operators.explain import explain, explain_row, importance
from foretell.operators.predict import anomaly, automl, impute, predict_trust
from foretell.plans.encode import EncodingError
from foretell.streaming.scoring import score_stream


def by_id(df):
    return {r.row_id: r for r in df.collect()}


def test_classes(spark):
    got = by_id(automl(bottles(spark), "sort", key="id"))
    assert [got[i].prediction for i in (13, 14, 15)] == [0, 1, 2] and all(r.task == "classify" for r in got.values())
    assert [r.imputed for r in impute(bottles(spark), "sort", key="id").orderBy("row_id").collect()] == [0, 1, 2]


def test_messy(spark):
    got = by_id(automl(frame(spark, MESSY, "wind string, rain boolean, base double, day int"), "day", key="id"))
    assert len(got) == 4 and [got[i].prediction for i in (10, 11, 12)] == [0, 1, 2]


def test_no_queries_and_order(spark):
    t = bottles(spark)
    assert automl(t.filter("sort is not null"), "sort", key="id").count() == 0
    assert by_id(automl(t.repartition(5), "sort", key="id")) == by_id(automl(t.coalesce(1), "sort", key="id"))
    p = frame(spark, plane(60, FAR), ABY)
    assert by_id(predict_trust(p.repartition(5), "y", key="id")) == by_id(predict_trust(p.coalesce(1), "y", key="id"))


def test_regression_is_accurate(spark):
    asked = [(3.0, 1.6), (2.6, 2.0), (6.0, 0.4)]
    t = frame(spark, plane(60, [(a, b, None) for a, b in asked]), ABY)
    got = by_id(automl(t, "y", key="id"))
    for i, (a, b) in zip((61, 62, 63), asked, strict=True):
        assert abs(got[i].prediction - (2 * a - 3 * b + 5)) < 1.2 and got[i].task == "regress"


def test_regression_confidence_and_trust(spark):
    t = frame(spark, plane(40, FAR), ABY)
    near, far = (by_id(automl(t, "y", key="id"))[i] for i in (41, 42))
    assert 0 <= far.confidence < near.confidence <= 1 and near.confidence - far.confidence > 0.01
    got = by_id(predict_trust(t, "y", key="id"))
    assert got[41].trust > 0.5 and not got[41].ood and got[42].ood and got[42].trust < 0.5
    assert all(r.confidence == r.trust for r in got.values())


def test_integer_targets_round(spark):
    t = frame(spark, [(float(g), g % 5, 3 * g + 10) for g in range(1, 31)] + [(31.0, 1, None)], "a double, b int, y int")
    r = automl(t, "y", key="id").first()
    assert r.task == "regress" and r.prediction == int(r.prediction)


def test_anomalies(spark):
    t = frame(spark, saddle(30, [(1.2, 1.3, 9.5)]), ABY)
    got = anomaly(t, "y", key="id").orderBy(F.desc("score")).collect()
    assert got[0].row_id == 31 and got[0].score > 3 and got[0].is_outlier and got[-1].score < 2
    scores = by_id(anomaly(bottles(spark), "sort", key="id"))
    assert len(scores) == 12 and all(0 <= r.score <= 1 for r in scores.values())


def test_conformal(spark):
    asked = [(1.0, 0.8), (2.6, 2.0), (4.0, 1.2)]
    t = frame(spark, saddle(60, [(a, b, None) for a, b in asked]), ABY)
    got = by_id(conformal_regress(t, "y", 0.9, key="id"))
    for i, (a, b) in zip((61, 62, 63), asked, strict=True):
        assert abs(got[i].prediction - (a * b - a * a / 2)) < 1.2 and got[i].lo <= a * b - a * a / 2 <= got[i].hi
    assert 0 <= conformal_threshold(ropes(spark), "kind", 0.9, key="id") <= 1
    assert conformal_threshold(ropes(spark), "kind", 0.0, key="id") >= conformal_threshold(ropes(spark), "kind", 0.9, key="id")
    with pytest.raises(EncodingError, match="coverage"):
        conformal_threshold(ropes(spark), "kind", 1.0, key="id")
    with pytest.raises(EncodingError, match=">= 4"):
        conformal_regress(frame(spark, plane(3, [(1.0, 1.0, None)]), ABY), "y", 0.9, key="id")
    with pytest.raises(EncodingError, match="categorical"):
        conformal_regress(ropes(spark), "kind", 0.9, key="id")


def test_importance(spark):
    import math

    assert importance(bottles(spark), "sort", key="id").orderBy(F.desc("importance")).first().feature == "volume"
    rows = [(g * 0.2, g * 29 % 13, g * 47 % 17, 4 * math.cos(0.3 * g)) for g in range(1, 46)]
    assert importance(frame(spark, rows, "a double, b int, c int, y double"), "y", key="id").orderBy(F.desc("importance")).first().feature == "a"


def test_explain_row(spark):
    t = frame(spark, [(float(g), 2.0, 4.0 * g - 3) for g in range(1, 36)] + [(90.0, 2.0, None)], "main double, flat double, y double")
    first, second = explain_row(t, "y", 36, key="id").collect()
    assert first.feature == "main" and first.contribution > 0 and first.direction == "increases" and first.value == 90 and abs(second.contribution) < 1e-6
    c = frame(spark, [(float(g + 30 * k), 2.0, k) for k in (0, 1) for g in range(1, 14)] + [(90.0, 2.0, None)], "main double, flat double, cls int")
    first, second = explain_row(c, "cls", 27, key="id").collect()
    assert first.feature == "main" and first.contribution >= 0 and first.direction == "toward" and abs(second.contribution) < 1e-6
    with pytest.raises(EncodingError, match="row_id=99"):
        explain_row(c, "cls", 99, key="id")


def test_explain(spark):
    story = explain(frame(spark, plane(40, [(2.0, 1.2, None)]), ABY), "y", key="id")
    assert story.startswith("40 rows say y, 1 do not: a number") and "give or take" in story and any(w in story for w in ("trusted", "check", "low trust"))
    assert "12 rows say sort, 3 do not: which of 3 classes" in (said := explain(bottles(spark), "sort", key="id")) and "leans on volume" in said


def test_few_labels(spark):
    with pytest.raises(EncodingError, match=">= 2"):
        predict_trust(frame(spark, [(1.0, 1.0, 2.0), (2.0, 2.0, None)], ABY), "y", key="id")
    assert automl(frame(spark, [(1.0, 1.0, 2.0), (2.0, 2.0, None)], ABY), "y", key="id").first().confidence == 0.5


def test_stream_scoring_agrees_with_the_table(spark, tmp_path):
    t = bottles(spark)
    path = str(tmp_path / "in")
    t.filter("sort is null").drop("sort").write.parquet(path)
    stream = spark.readStream.schema(t.drop("sort").schema).parquet(path)
    q = score_stream(stream, t, "sort", ["id"]).writeStream.format("memory").queryName("scored").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {r.id: (r.prediction, r.confidence, r.trust, r.ood) for r in spark.table("scored").collect()}
    assert got == {r.row_id: (r.prediction, r.confidence, r.trust, r.ood) for r in predict_trust(t, "sort", key="id").collect()}


def test_models_are_fitted_on_a_sample_and_score_all_rows(spark):
    from foretell.plans.encode import encode

    t = frame(spark, plane(40, FAR), ABY)
    e = encode(t, "y", key="id", sample_support=10)
    with pytest.warns(UserWarning, match="10 of 40"):
        x = e.support()[1]
    assert len(x) == 10 and e.queries().count() == 2 and e.n_support == 40
    assert anomaly(e).count() == 40  # rows that the model was not fitted on have a score too
    more = encode(t.union(frame(spark, [(1.0, 1.0, 4.0)], ABY).withColumn("id", F.lit(1000))), "y", key="id", sample_support=10)
    with pytest.warns(UserWarning):
        kept = {tuple(r) for r in more.support()[1].tolist()}
    assert len(kept & {tuple(r) for r in x.tolist()}) >= 9  # the sample hangs on the keys, not on the rows' numbers


def test_many_labeled_rows_all_count(spark):
    import warnings

    import numpy as np

    from foretell.models.kernel import EVEN, WIDTH
    from foretell.plans.encode import MANY_SUPPORT

    n = MANY_SUPPORT + 500
    a, b = (np.arange(n) * 7919 % 97).astype(float), (np.arange(n) * 31 % 11).astype(float)
    a[-400:] = 500.0  # the last rows are far from all others, and of a class of their own
    y = np.where(np.arange(n) < n - 400, np.arange(n) * 13 % 2, 2)
    t = spark.range(n).selectExpr("id", f"cast(if(id < {n - 400}, id * 7919 % 97, 500) as double) a", "cast(id * 31 % 11 as double) b", f"cast(if(id < {n - 400}, id * 13 % 2, 2) as int) y")
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        got = {r.feature: r.contribution for r in explain_row(t, "y", 1, key="id").collect()}
    x = np.stack([a, b], 1)
    rows = np.tile(x[0], (3, 1))
    rows[1, 0], rows[2, 1] = a.mean(), b.mean()
    d2 = (((rows[:, None] - x) / x.std(0)) ** 2).sum(2)
    w = np.exp(-(d2 - d2.min(1, keepdims=True)) / (2 * WIDTH * 2))
    p = (1 - EVEN) * np.stack([w[:, y == c].sum(1) for c in range(3)], 1) / w.sum(1, keepdims=True) + EVEN / 3
    of = p[:, p[0].argmax()]
    assert got == {"a": pytest.approx(of[0] - of[1], abs=1e-12), "b": pytest.approx(of[0] - of[2], abs=1e-12)}


def test_trees_of_many_labeled_rows(spark):
    import warnings

    import numpy as np

    from foretell.models import gbm
    from foretell.plans.encode import MANY_SUPPORT

    n = MANY_SUPPORT + 500
    t = spark.range(n + 50).selectExpr("id", "cast(id % 90 as double) a", "cast(id * 7 % 13 as double) b", f"if(id < {n}, cast(id * 7919 % 1000 + id % 90 as double) / 4, null) y")
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        got = [r.imputed for r in impute(t, "y", key="id").orderBy("row_id").collect()]
    i = np.arange(n + 50)
    x, y = np.stack([i % 90, i * 7 % 13], 1).astype(float), (i * 7919 % 1000 + i % 90) / 4.0
    want = gbm.fit(x[:n], y[:n]).predict(x[n:])
    assert got == (np.floor(want * 10 + 0.5) / 10).tolist()


def test_a_fit_to_sums_is_the_fit_to_rows():
    import numpy as np

    from foretell.models import gbm

    rng = np.random.default_rng(5)
    x, y = rng.integers(0, [100, 5, 3], (3000, 3)).astype(float), rng.normal(size=3000)
    unit = gbm.unit_of(np.abs(y).max())
    v, at = np.unique(x, axis=0, return_inverse=True)
    one, two = gbm.fit(x, y), gbm.fit_sums(v, np.bincount(at.ravel(), np.floor(y / unit + 0.5)), np.bincount(at.ravel()), unit)
    assert len(v) < 1500 and (one.predict(x) == two.predict(x)).all()


def test_equal_rows_may_be_counted_together(spark, monkeypatch):
    from foretell.plans import encode

    t = frame(spark, [(float(g % 5), float(g * g % 7), g % 3 if g % 10 else None) for g in range(1, 300)], "a double, b double, y int")
    r = frame(spark, [(float(g % 5), float(g * g % 7), g * 0.37 % 5 if g % 10 else None) for g in range(1, 300)], ABY)
    ask = lambda: [sorted(map(tuple, f.collect())) for f in (predict_trust(t, "y", key="id"), explain_row(t, "y", 4, key="id"), anomaly(t, "y", key="id"), importance(t, "y", key="id"), predict_trust(r, "y", key="id"), explain_row(r, "y", 4, key="id"), conformal_regress(r, "y", 0.9, key="id"))]
    here = ask()
    monkeypatch.setattr(encode, "MANY_SUPPORT", 20)
    for one, two in zip(here, ask(), strict=True):
        assert len(one) == len(two) and all(v == (pytest.approx(u, abs=1e-9) if isinstance(u, float) else u) for a, b in zip(one, two, strict=True) for u, v in zip(a, b, strict=True))


def test_a_fit_does_not_hang_on_the_order_of_rows():
    import numpy as np

    from foretell.models import gbm

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(500, 3)), rng.normal(size=500)
    x[:, 2] = np.round(x[:, 2])
    p = rng.permutation(500)
    assert (gbm.fit(x, y).predict(x) == gbm.fit(x[p], y[p]).predict(x)).all()
    assert gbm.fit(x, np.zeros(500)).predict(x).tolist() == [0.0] * 500 and gbm.fit(x[:1], y[:1]).predict(x[:1])[0] == pytest.approx(y[0])
    wide = gbm.cuts_of(np.arange(1000.0))
    assert len(wide) == gbm.BINS - 1 and (np.diff(wide) > 0).all() and gbm.cuts_of(np.ones(5)).tolist() == []


def test_large_supports_are_compared_in_tasks(spark, monkeypatch):
    from foretell.models import scoring

    t = frame(spark, [(float(g % 17), float(g % 23), g % 3) for g in range(1, 1200)] + [(3.5, 9.0, None)], "a double, b double, y int")
    here = by_id(predict_trust(t, "y", key="id")), importance(t, "y", key="id").collect(), conformal_threshold(t, "y", 0.9, key="id")
    monkeypatch.setattr(scoring, "LOCAL_PAIRS", 1000)
    assert (by_id(predict_trust(t, "y", key="id")), importance(t, "y", key="id").collect(), conformal_threshold(t, "y", 0.9, key="id")) == here
