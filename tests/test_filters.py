import pytest

from quillspark.functions import filters as L


@pytest.fixture(scope="module")
def points(spark):
    rows = [(1, "a", 0, "company.hr", ["x"]), (2, None, None, None, None), (3, "b", 3, "company.hr_contractors", ["y", "z"]), (4, "a", 4, "company.hr.people", [])]
    return spark.createDataFrame(rows, "id int, mode string, level int, path string, tags array<string>")


def ids(df, condition):
    return [r.id for r in df.filter(condition.column(df.schema)).orderBy("id").collect()]


def test_missing_values_match_nothing_but_survive_must_not(points):
    assert ids(points, L.Match("mode", "a")) == [1, 4]
    assert ids(points, L.VectorFilter(must_not=(L.Match("mode", "a"),))) == [2, 3]
    assert ids(points, L.Range("level", lt=9)) == [1, 3, 4]
    assert ids(points, L.IsNull("mode")) == [2]


def test_prefixes_are_whole_segments(points):
    assert ids(points, L.PrefixMatch("path", "company.hr")) == [1, 4]


def test_empty_groups(points):
    assert ids(points, L.Or(())) == []
    assert ids(points, L.And(())) == [1, 2, 3, 4]
    assert ids(points, L.In("mode", ())) == []


def test_arrays(points):
    assert ids(points, L.HasAny("tags", ("x", "z"))) == [1, 3]
    assert ids(points, L.Match("tags", "y")) == [3]


def test_should_counts(points):
    f = L.VectorFilter(should=(L.Match("mode", "a"), L.Range("level", gte=4), L.HasAny("tags", ("x",))), min_should=2)
    assert ids(points, f) == [1, 4]


def test_intersection_only_narrows(points):
    a, b = L.VectorFilter(should=(L.Match("mode", "a"), L.Match("mode", "b"))), L.VectorFilter(must=(L.Range("level", gte=3),))
    assert ids(points, a.intersect(b)) == [3, 4]
    assert a.intersect(None) is a


def test_unknown_field_raises(points):
    with pytest.raises(L.UnknownField):
        L.Match("nothing", 1).column(points.schema)


def test_filters_reach_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    plan = df.filter(L.VectorFilter(must=(L.Range("o_totalprice", gt=1000.0),)).column(df.schema)).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "o_orderdate" not in plan
