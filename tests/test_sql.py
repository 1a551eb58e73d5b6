import pytest
from pyspark.sql import functions as F
from tables import ABY, FAR, bottles, frame, plane, ropes

from foretell.operators import view
from foretell.operators.predict import automl, detect_task
from foretell.plans.joins import as_of, range_join
from foretell.sql import sql


def test_operators_in_statements(spark):
    bottles(spark).createOrReplaceTempView("bottles")
    frame(spark, plane(40, FAR), ABY).createOrReplaceTempView("points")
    got = sql(spark, "SELECT b.id, p.prediction FROM bottles b JOIN ft_automl('bottles', 'sort', key => 'id') p ON p.row_id = b.id /* ft_automl( */ -- ft_impute('x'")
    assert {r.id: r.prediction for r in got.collect()} == {r.row_id: r.prediction for r in automl(bottles(spark), "sort", key="id").collect()}
    r = sql(spark, "select FT_detect_task('points', 'y', key => 'id') as task, 'it''s ft_explain(' as text, ft_conformal_threshold('bottles', 'sort', 0.5, key => 'id') as t").first()
    assert r.task == detect_task(frame(spark, plane(40, FAR), ABY), "y", key="id") and r.text == "it's ft_explain(" and 0 <= r.t <= 1
    assert sql(spark, "SELECT count(DISTINCT cluster) AS n FROM ft_cluster('points', 2, key => 'id', order_by => 'a, b')").first().n == 2
    said = sql(spark, "SELECT ft_create_view('points', 'y', 'predict', 3, FALSE, key => 'id') AS said").first().said
    assert "points_ml: view of this session" in said and spark.table("points_ml").count() == 42
    assert "points_ml" in sql(spark, "SELECT ft_refresh_view('points_ml')").first()[0]
    view.drop_view("points_ml")
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("ft_auto")]
    for bad in ("SELECT * FROM ft_automl(points, 'y')", "SELECT * FROM ft_automl('points', 'y', 'z')", "SELECT * FROM ft_automl('points', upper('y'))"):
        with pytest.raises(ValueError, match="ft_automl takes"):
            sql(spark, bad)


def test_windows_in_statements(spark):
    ropes(spark).createOrReplaceTempView("sql_ropes")
    rows = sql(spark, "SELECT a.id, a.score, c.cluster FROM ft_anomaly_over('sql_ropes', 'width, load') a JOIN ft_cluster_over('sql_ropes', 'width,stretch,load', '') c USING (id)").collect()
    assert len(rows) == 11 and {r.cluster for r in rows} == {0, 1, 2} and all(r.score >= 0 for r in rows)


def test_as_of(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 10), (3, "b", 1), (4, "a", 300), (5, None, 7), (6, "c", None)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 4, "x"), ("a", 10, "y"), ("a", 10, "z"), ("b", 2, "w"), ("a", 120, "u"), (None, 6, "n"), ("a", None, "q")], "k string, at int, v string")
    want = {1: "x", 2: "z", 3: None, 4: "u", 5: "n", 6: None}
    for width in (1, 100, 10_000):
        assert {r.id: r.v for r in as_of(left, right, "t", "at", ["k"], F.floor(F.col("t_") / width)).collect()} == want


def test_range_join(spark):
    points = spark.createDataFrame([(i, float(i) / 2 - 3) for i in range(20)] + [(99, None)], "id int, x double")
    ranges = spark.createDataFrame([("a", -1.0, 1.0), ("b", 0.5, 0.5), ("c", 3.0, 2.0), ("d", -100.0, 100.0), ("e", None, 1.0)], "name string, lo double, hi double")
    want = sorted((i, n) for i, x in ((i, i / 2 - 3) for i in range(20)) for n, lo, hi in (("a", -1, 1), ("b", 0.5, 0.5), ("d", -100, 100)) if lo <= x <= hi)
    for width in (0.3, 50.0):
        assert sorted((r.id, r.name) for r in range_join(points, ranges, "x", "lo", "hi", width).collect()) == want
