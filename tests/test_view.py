import pytest
from tables import ABY, FAR, ONE_LABEL, frame, plane, ropes

from foretell.operators import view
from foretell.operators.cluster import cluster
from foretell.operators.predict import anomaly, predict_trust


@pytest.fixture
def saved(spark):
    names = []

    def save(df, name):
        names.append(name)
        df.write.mode("overwrite").saveAsTable(name)
        return name

    yield save
    for n in names:
        view.drop_view(f"{n}_ml")
        spark.sql(f"DROP TABLE IF EXISTS {n}")


def test_view_agrees_with_direct_calls_and_refreshes(spark, saved):
    name = saved(ropes(spark), "ropes")
    said = view.create_view(name, "kind", key="id")
    assert said.startswith("ropes_ml: saved table") and "cluster, anomaly_score, predicted, confidence, trust, ood, trust_label, band" in said and "apart by id" in said
    got = {r.id: r for r in spark.table("ropes_ml").collect()}
    t = spark.table(name)
    direct = {r.row_id: r for r in predict_trust(t, "kind", key="id").collect()}
    scores = {r.row_id: r.score for r in anomaly(t, "kind", key="id").collect()}
    labels = {r.row_id: r.cluster for r in cluster(t, 3, "kind", key="id").collect()}
    for i, r in got.items():
        assert r.cluster == labels[i] and r.anomaly_score == scores.get(i) and r.band is None
        assert (r.predicted, r.confidence, r.trust, r.ood) == ((d := direct[i]).prediction, d.confidence, d.trust, d.ood) if i in direct else r.predicted is None
    ropes(spark).selectExpr("id + 100 as id", "width", "stretch", "load", "kind").write.mode("append").saveAsTable(name)
    view.RECIPES.clear()  # as in a later session: the recipe is in the table's properties
    view.refresh_view("ropes_ml")
    assert spark.table("ropes_ml").count() == 22


def test_tables_of_others_stay(spark, saved):
    name = saved(ropes(spark), "own")
    spark.range(3).write.mode("overwrite").saveAsTable("own_ml")
    try:
        for call in (lambda: view.create_view(name, "kind", key="id"), lambda: view.create_view(name, "kind", materialized=False, key="id"), lambda: view.drop_view("own_ml")):
            with pytest.raises(ValueError, match="did not make"):
                call()
        with pytest.raises(ValueError, match="no recipe"):
            view.refresh_view("own_ml")
        assert spark.table("own_ml").count() == 3
    finally:
        spark.sql("DROP TABLE own_ml")


def test_regression_view(spark, saved):
    view.create_view(saved(frame(spark, plane(40, FAR), ABY), "band"), "y", key="id", materialized=False)
    got = [r for r in spark.table("band_ml").collect() if r.predicted is not None]
    assert sum(r.ood for r in got) == 1 and all(r.confidence == r.trust and r.band > 0 for r in got)
    assert {r.trust_label for r in got} <= {"trusted", "check", "low trust"} and next(r for r in got if r.ood).trust_label == "low trust"


def test_one_label(spark, saved):
    view.create_view(saved(frame(spark, ONE_LABEL, ABY), "one"), "y", key="id")
    got = spark.table("one_ml").collect()
    assert len(got) == 4 and all(r.trust is None and r.ood is None and r.cluster is not None for r in got)
    assert sum(r.predicted is not None for r in got) == 3 and sum(r.anomaly_score is not None for r in got) == 1


def test_parts_and_no_target(spark, saved):
    said = view.create_view(saved(ropes(spark).drop("kind"), "bare"), key="id")
    assert "its source and cluster;" in said
    assert "predicted" in view.view_frame(ropes(spark), "kind", "impute, unknown", key="id").columns
