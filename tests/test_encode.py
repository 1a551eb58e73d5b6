import datetime
import decimal

import pytest
from tables import MESSY, frame

from foretell.operators.predict import detect_task
from foretell.plans.encode import EncodingError, encode


def rows(e):
    return [(r.row_id, r.y, list(r.x)) for r in e.df.orderBy("row_id").collect()]


def test_messy_table(spark):
    e = encode(frame(spark, MESSY, "wind string, rain boolean, base double, day int"), "day", key="id")
    assert e.features == ["wind", "rain", "base"] and e.kinds == ["categorical", "boolean", "numeric"]
    assert e.levels["wind"] == ["east", "north", "west"]
    got = rows(e)
    assert got[12][2][0] == 3.0  # an unseen level
    assert got[4][2][2] == 3.0 and got[3][2][1] == 0.75  # means of the known rows
    assert any("imputed 1 missing" in n for n in e.notes)


@pytest.mark.parametrize("n,kept", [(50, True), (51, False)])
def test_levels(spark, n, kept):
    e = encode(frame(spark, [(f"v{i % n}", 1.0) for i in range(2 * n)], "t string, x double"), key="id")
    assert ("t" in e.features) is kept


@pytest.mark.parametrize("values,kept", [(["a", "b", "c", "d"], True), (["a", "b", "c", "d", "e"], False), (["a"] * 2 + list("bcdefghi"), True)])
def test_distinct_share(spark, values, kept):
    assert ("t" in encode(frame(spark, [(v, 1.0) for v in values], "t string, x double"), key="id").features) is kept


def test_words_and_nulls(spark):
    e = encode(frame(spark, [("Yes", None, None), (" no", None, None), ("t", None, None), ("yes\n", None, None)], "w string, gone string, empty double"), key="id")
    assert e.features == ["w", "empty"] and "gone: all-NULL text column dropped" in e.notes
    got = rows(e)
    assert [x[0] for _, _, x in got] == [1.0, 0.0, 1.0, pytest.approx(2 / 3)]  # white space other than spaces passes detection only
    assert all(x[1] == 0.0 for _, _, x in got)


def test_dates_and_ignored_types(spark):
    d = spark.createDataFrame([(1, datetime.date(1970, 1, 2), datetime.datetime(1970, 1, 1, 0, 0, 1, 500000), [1], 5)], "id long, d date, t timestamp, a array<int>, n int")
    e = encode(d, "n", key="id")
    assert e.features == ["d", "t"] and rows(e)[0][2] == [86400.0, 1.5]


@pytest.mark.parametrize(
    "values,kind,task",
    [
        (["yes", "no", "y", None], "string", "classify (2 classes"),
        (["0", "1", "1", None], "string", "regress"),
        (["1.0d", "2", "x", None], "string", "classify (3 classes"),
        (["a"] * 3, "string", "regress"),
        ([0, 1, 0], "int", "classify (2"),
        ([decimal.Decimal(0), decimal.Decimal(1)], "decimal(5,0)", "regress"),
        ([True, False], "boolean", "classify (2"),
        ([datetime.date(2020, 1, 1), datetime.date(2020, 1, 2)], "date", "regress"),
        (list(range(11)), "int", "regress"),
        (list(range(10)), "int", "classify (10"),
        ([5, 5], "int", "regress"),
    ],
)
def test_task(spark, values, kind, task):
    t = frame(spark, [(float(i), v) for i, v in enumerate(values)], f"x double, y {kind}")
    assert detect_task(t, "y", key="id").startswith(task)


def test_errors(spark):
    t = frame(spark, [(f"v{i}", float(i)) for i in range(11)], "y string, x double")
    with pytest.raises(EncodingError, match="distinct labels"):
        encode(t, "y", key="id")
    with pytest.raises(EncodingError, match="not found"):
        encode(t, "z", key="id")
    with pytest.raises(EncodingError, match="no usable"):
        encode(t.select("id", "x"), "x", key="id")
    with pytest.raises(EncodingError, match="order"):
        encode(t, "x")
    with pytest.raises(EncodingError, match="no labeled"):
        detect_task(frame(spark, [(1.0, None)], "x double, y int"), "y", key="id")


def test_row_ids_by_ranges(spark):
    from foretell.plans import ordinal

    t = spark.range(5000).selectExpr("(id * 7919) % 5000 as k", "id")
    assert [r.row_id for r in ordinal.with_row_id(t, ["k"]).orderBy("k").select("row_id").collect()] == list(range(1, 5001))
    tied = spark.range(3000).selectExpr("id % 3 as k", "id * 17 % 3000 as v")
    one, two = ({(r.k, r.v): r.row_id for r in ordinal.with_row_id(tied.repartition(n, *c), ["k"]).collect()} for n, c in ((3, ["v"]), (7, ["k", "v"])))
    assert one == two and sorted(one.values()) == list(range(1, 3001))
    assert ordinal.with_row_id(t.limit(0), ["k"]).count() == 0


def test_wide_columns_are_not_read_again_after_profiling(spark, tmp_path):
    """Numbers are given to narrow rows: once the text columns are profiled, no plan reads a text that is no feature."""
    path = str(tmp_path / "t")
    spark.range(2000).selectExpr("id", "repeat(cast(id as string), 50) as text", "id % 7 as f", "if(id % 3 = 0, null, id % 2) as y").write.parquet(path)
    e = encode(spark.read.parquet(path), "y", key="id")
    plan = e.df._jdf.queryExecution().optimizedPlan().toString()
    assert e.features == ["f"] and "text" not in plan and "Window" not in plan
    assert len(e.base().columns) == 5 and e.base().count() == 2000
    with pytest.raises(EncodingError, match="tells them apart"):
        encode(spark.read.parquet(path), "y", order_by="f").base()


def test_keys_from_the_catalog(spark):
    from foretell.sources.tables import columns_of

    frame(spark, MESSY, "wind string, rain boolean, base double, day int").write.mode("overwrite").saveAsTable("keyed")
    try:
        with pytest.raises(EncodingError, match="order"):
            encode("keyed", "day")
        spark.sql("ALTER TABLE keyed SET TBLPROPERTIES ('foretell.key' = 'id')")
        assert encode("keyed", "day").features == ["wind", "rain", "base"]
        assert [(r.name, r.kind) for r in columns_of("keyed").filter("not is_key").orderBy("place").collect()] == [("wind", "text"), ("rain", "boolean"), ("base", "numeric"), ("day", "numeric")]
    finally:
        spark.sql("DROP TABLE keyed")
