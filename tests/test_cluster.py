import numpy as np
import pytest
from tables import bottles, ropes

from foretell.operators import cluster as c
from foretell.operators.windows import anomaly_over
from foretell.plans import joins
from foretell.plans.encode import EncodingError


def plain(z, k):
    """The definition, one number at a time."""
    n, d, u = len(z), len(z[0]), c.draws()
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    centres = [list(z[int(next(u) * n) % n])]
    while len(centres) < k:
        w = [min(dist(r, m) for m in centres) for r in z]
        if sum(w) <= 0:
            centres.append(list(z[int(next(u) * n) % n]))
            continue
        left, pick = next(u) * sum(w), n - 1
        for i, x in enumerate(w):
            left -= x
            if left <= 0:
                pick = i
                break
        centres.append(list(z[pick]))
    labels = [0] * n
    for _ in range(100):
        new = [min(range(k), key=lambda j: (dist(r, centres[j]), j)) for r in z]
        changed, labels = new != labels, new
        for j in range(k):
            own = [z[i] for i in range(n) if labels[i] == j]
            if own:
                centres[j] = [sum(r[x] for r in own) / len(own) for x in range(d)]
        if not changed:
            break
    return labels


@pytest.mark.parametrize("seed", range(6))
def test_kmeans_is_as_defined(seed):
    z = np.sort(np.random.default_rng(seed).normal(size=(40, 1)), 0).repeat(2, 1)
    assert c.kmeans(z, 4).tolist() == plain(z.tolist(), 4)


def test_groups_and_limits(spark):
    got = c.cluster(bottles(spark), 3, "sort", key="id").collect()
    assert len(got) == 15 and {r.cluster for r in got} == {0, 1, 2}
    assert c.cluster(bottles(spark).limit(2), 5, key="id").count() == 2
    assert c.cluster(bottles(spark).filter("id < 0"), 2, key="id").count() == 0
    with pytest.raises(EncodingError):
        c.cluster(bottles(spark), 0, key="id")
    assert c.labels_of(np.ones((5, 2)), 3).tolist() == c.labels_of(np.ones((5, 2)), 3).tolist()


def test_over_agrees_with_table_and_ignores_order(spark):
    t = ropes(spark)
    over = {r.id: r.cluster for r in c.cluster_over(t, ["width", "stretch", "load"], []).collect()}
    table = {r.row_id: r.cluster for r in c.cluster(t.drop("kind"), 3, key="id").collect()}
    assert over == table
    with pytest.raises(Exception, match="nulls"):
        c.cluster_over(t, ["kind"], []).collect()


def test_distributed_agrees(spark, monkeypatch):
    rng = np.random.default_rng(5)
    t = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(300, 2)) + rng.integers(0, 3, (300, 1)) * 6)], "id long, x double, y double")
    local = {r.row_id: r.cluster for r in c.cluster(t, 3, key="id").collect()}
    monkeypatch.setattr(c, "LOCAL_ROWS", 10)
    assert {r.row_id: r.cluster for r in c.cluster(t, 3, key="id").collect()} == local


def test_anomaly_over(spark, monkeypatch):
    t = ropes(spark)
    x = np.array([r[1:4] for r in sorted(t.collect())])
    want = np.sqrt((((x - x.mean(0)) / x.std(0)) ** 2).mean(1))
    names = ["width", "stretch", "load"]
    got = [r.score for r in anomaly_over(t, names).orderBy("id").collect()]
    assert np.abs(want - got).max() < 1e-9
    arrays = t.selectExpr("id", "array(width, stretch, load) as v", "if(id % 2 = 0, null, id % 3) as g")
    assert [r.s for r in anomaly_over(arrays, "v", name="s").orderBy("id").collect()] == got
    by = {}
    for r in anomaly_over(arrays, "v", ["g"]).collect():
        by.setdefault(r.g, []).append((r.v, r.score))
    assert len(by) == 4  # rows without a group are one
    monkeypatch.setattr(joins, "KEY_ROWS", 2)  # groups beyond it are dealt to several tasks
    spread = {tuple(r.v): r.score for r in anomaly_over(arrays, "v", ["g"]).collect()}
    assert len(spread) == 11 and all(spread[tuple(v)] == pytest.approx(s) for rows in by.values() for v, s in rows)
    for rows in by.values():
        x = np.array([v for v, _ in rows])
        sd = x.std(0)
        assert np.abs(np.sqrt((((x - x.mean(0)) / np.where(sd == 0, 1, sd)) ** 2).mean(1)) - [s for _, s in rows]).max() < 1e-9


@pytest.mark.parametrize("rows,match", [([[1.0], None], "without nulls"), ([[1.0], []], "one component"), ([[1.0], [None]], "without nulls"), ([[1.0], [1.0, 2.0]], "one length")])
def test_what_windows_refuse(spark, rows, match):
    t = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "id long, v array<double>")
    for f in (anomaly_over, c.cluster_over):
        with pytest.raises(Exception, match=match):
            f(t, "v", []).collect()
