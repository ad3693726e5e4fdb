import math

import pytest
from pyspark.sql import functions as F

from lakemill.functions import geometry as G
from lakemill.functions import overlay as O
from lakemill.plans.frame import FrameError
from lakemill.plans.geoframe import GeoFrame

W = G.parse_wkt
SQUARE, HOLE = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"


@pytest.fixture()
def frame(spark):
    data = [(1, HOLE), (2, "POINT ZM (1 2 3 4)"), (3, "LINESTRING (0 0, 3 4, 3 8)"), (4, "POLYGON EMPTY"), (5, None), (6, "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))"), (7, "MULTIPOINT ((1 1), (3 5))")]
    d = spark.createDataFrame(data, "id int, w string")
    out = GeoFrame(d.select("id", G.from_wkt(F.col("w")).alias("g")), geometry="g")
    out.index = "id"
    return out


def values(frame, series):
    return [r[0] for r in frame.base.select(*[e.alias("v") for e in series.cols.values()]).collect()]


def test_wkt_round_trip():
    for t in (SQUARE, HOLE, "POINT Z (1 2 3)", "MULTIPOINT ((1 1), (3 5))", "LINESTRING EMPTY", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))"):
        assert G.to_wkt(W(t)) == t
    with pytest.raises(ValueError):
        W("CIRCLE (1)")


def test_accessors(frame):
    v = lambda s: values(frame, s)
    assert v(frame.area()) == [15, 0, 0, None, None, 1, 0]
    assert v(frame.num_points()) == [10, 1, 3, None, None, 8, 2]
    assert v(frame.dimension()) == [2, 0, 1, -1, None, 2, 0]
    assert v(frame.coord_dim()) == [2, 4, 2, 2, None, 2, 2]
    assert v(frame.is_empty()) == [0, 0, 0, 1, None, 0, 0]
    assert v(frame.max_x()) == [4, 1, 3, None, None, 6, 3] and v(frame.min_z()) == [None, 3, None, None, None, None, None]
    assert v(frame.mbr().as_wkt())[1:3] == ["POINT (1 2)", "POLYGON ((0 0, 3 0, 3 8, 0 8, 0 0))"]
    assert v(frame.centroid().as_wkt())[0] == "POINT (2 2)"
    assert v(frame.is_simple()) == [1, 1, 1, 1, None, 1, 1] and v(frame.is_valid())[0] == 1
    assert v(frame.geometry_type())[0] == "ST_POLYGON"
    line = frame[frame["id"] == 3]
    one = lambda s: values(line, s)[0]
    assert one(line.length()) == 9 and one(line.is_closed()) == 0
    assert one(line.mid_point().as_wkt()) == "POINT (2.7 3.6)" and one(line.end_point().as_wkt()) == "POINT (3 8)"
    assert one(line.boundary().as_wkt()) == "MULTIPOINT ((0 0), (3 8))"
    assert values(frame[frame["id"] == 1], frame[frame["id"] == 1].num_interior_ring()) == [1]
    with pytest.raises(TypeError):
        frame.geometry.min()
    with pytest.raises(TypeError):
        frame.generalize("a")
    with pytest.raises(ValueError):
        frame.generalize(-1)
    with pytest.raises(ValueError):
        frame.area("parsec")
    with pytest.raises(TypeError):
        frame.set_geometry("id")


def test_earth_measures(spark):
    assert G.earth_distance(0, 0, 1, 0) == pytest.approx(111_319.49, rel=1e-6)
    assert G.earth_distance(-97.74, 30.27, -104.99, 39.74) == pytest.approx(1_238_100, rel=5e-3)
    d = spark.range(1).select(G.rectangle(F.lit(0), F.lit(0), F.lit(1), F.lit(1), 4326).alias("g"), G.point(F.lit(0), F.lit(0), 4326).alias("a"), G.point(F.lit(1), F.lit(0), 4326).alias("b"))
    r = d.select(G.area(F.col("g"), "KILOMETER"), G.point_distance(F.col("a"), F.col("b"), "KILOMETER"), G.point_distance(F.col("a"), F.col("b"))).first()
    assert r[0] == pytest.approx(12_363, rel=2e-3) and r[1] == pytest.approx(111.319, rel=1e-4) and r[2] == 1


def area(g):
    if g is None:
        return 0
    return sum((1 if k == 0 else -1) * abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False)) / 2) for part in g[4] for k, r in enumerate(part))


def test_overlay():
    a, b = W(SQUARE), W("POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))")
    tri = W("POLYGON ((0 0, 6 0, 3 9, 0 0))")
    assert area(O.combine("intersection", a, b)) == pytest.approx(4)
    assert area(O.combine("union", a, b)) == pytest.approx(28)
    assert area(O.combine("difference", a, b)) == pytest.approx(12)
    assert area(O.combine("difference", W(HOLE), b)) == pytest.approx(11)
    x, y, z = (area(O.combine(k, a, tri)) for k in ("intersection", "union", "difference"))
    assert x + y == pytest.approx(area(a) + area(tri)) and x + z == pytest.approx(16)
    assert G.to_wkt(O.combine("intersection", a, W("POLYGON ((9 9, 10 9, 10 10, 9 9))"))) == "POINT EMPTY"
    assert area(O.hull(W("MULTIPOINT ((0 0), (4 0), (4 4), (0 4), (2 2))"))) == 16
    assert area(O.buffer(W("POINT (1 1)"), 2)) == pytest.approx(4 * math.pi, rel=0.01)
    assert area(O.buffer(a, 1)) == pytest.approx(16 + 16 + math.pi, rel=0.01)
    assert area(O.buffer(a, -1)) == pytest.approx(4, rel=0.01)
    assert len(O.generalize(W("LINESTRING (0 0, 1 0.01, 2 0, 3 5)"), 0.1)[4][0][0]) == 3
    assert O.is_simple(W("LINESTRING (0 0, 2 2, 0 2, 2 0)")) == 0 and O.is_valid(W("POLYGON ((0 0, 1 1, 0 0))")) == 0


@pytest.mark.parametrize(
    ("a", "b", "true"),
    [
        (SQUARE, SQUARE, "intersects equals within contains"),
        (SQUARE, "POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))", "intersects overlaps"),
        ("POLYGON ((1 1, 2 1, 2 2, 1 1))", SQUARE, "intersects within"),
        (SQUARE, "POLYGON ((4 0, 8 0, 8 4, 4 4, 4 0))", "intersects touches"),
        (SQUARE, "POLYGON ((9 9, 10 9, 10 10, 9 9))", "disjoint"),
        ("LINESTRING (-1 2, 5 2)", SQUARE, "intersects crosses"),
        ("LINESTRING (1 1, 2 2)", SQUARE, "intersects within"),
        ("LINESTRING (0 0, 2 2)", "LINESTRING (0 2, 2 0)", "intersects crosses"),
        ("LINESTRING (0 0, 2 0)", "LINESTRING (1 0, 3 0)", "intersects overlaps"),
        ("POINT (2 2)", SQUARE, "intersects within"),
        ("POINT (4 2)", SQUARE, "intersects touches"),
        (SQUARE, "POINT (1 1)", "intersects contains"),
        ("POLYGON EMPTY", SQUARE, "disjoint"),
    ],
)
def test_predicates(a, b, true):
    got = {p for p in ("intersects", "equals", "within", "contains", "overlaps", "touches", "crosses", "disjoint") if O.predicate(p, W(a), W(b))}
    assert got == set(true.split())


def test_pairs(frame, spark):
    d = spark.createDataFrame([(10, "POINT (0.5 0.5)"), (11, "POINT (9 9)")], "k int, w string")
    other = GeoFrame(d.select("k", G.from_wkt(F.col("w")).alias("p")), geometry="p")
    with pytest.raises(FrameError):
        frame.contains(other)
    other.index = "k"
    got = {(r["INDEXERIDA1"], r["INDEXERIDA2"]): r["RESULT"] for r in frame.contains(other).df.collect()}
    assert got[1, 10] == 1 and got[1, 11] == 0 and got[5, 10] is None and len(got) == 14
    fast = {tuple(r) for r in frame.matching(other, "contains", 2.0).df.collect()}
    assert fast == {k for k, v in got.items() if v == 1}
    far = {(r["INDEXERIDA1"], r["INDEXERIDA2"]): r["RESULT"] for r in frame.distance(other).df.collect()}
    assert far[1, 10] == 0 and far[2, 10] == pytest.approx(math.hypot(0.5, 1.5)) and far[1, 11] == pytest.approx(math.hypot(5, 5))
    assert isinstance(frame[["id", "g"]], GeoFrame) and not isinstance(frame[["id"]], GeoFrame)


def plan(df):
    return df._jdf.queryExecution().toString()


def indexed(spark, texts):
    out = GeoFrame(spark.createDataFrame(list(enumerate(texts)), "id int, w string").select("id", G.from_wkt(F.col("w")).alias("g")).localCheckpoint(), geometry="g")
    out.index = "id"
    return out


def test_distances_of_points_need_no_python(spark):
    a, b = indexed(spark, ["POINT (0 0)", None, "POINT (3 4)"]), indexed(spark, ["POINT (0 4)"])
    d = a.distance(b).df
    assert "Python" not in plan(d)
    assert {r["INDEXERIDA1"]: r["RESULT"] for r in d.collect()} == {0: 4, 1: None, 2: 3}
    mixed = indexed(spark, ["POINT (0 4)", SQUARE, None])
    got = {(r["INDEXERIDA1"], r["INDEXERIDA2"]): r["RESULT"] for r in a.distance(mixed).df.collect()}
    assert got == {(0, 0): 4, (0, 1): 0, (0, 2): None, (1, 0): None, (1, 1): None, (1, 2): None, (2, 0): 3, (2, 1): 0, (2, 2): None}


def test_boxes_are_found_before_rows_meet(spark):
    a, b = indexed(spark, [SQUARE, "POINT (9 9)", None]), indexed(spark, [HOLE, "POLYGON EMPTY"])
    d = a.mbr_intersects(b).df
    top = plan(d).split("Optimized Logical Plan")[1].split("Join Cross")[0]
    assert "flatten" not in top
    assert {(r[0], r[1]): r[2] for r in d.collect()} == {(0, 0): 1, (1, 0): 0, (2, 0): None, (0, 1): None, (1, 1): None, (2, 1): None}


def test_a_box_is_found_once(spark):
    a = indexed(spark, [SQUARE, "POINT (9 9)", "LINESTRING (1 2, 1 5)", "POLYGON EMPTY", None])
    d = a.df.select(G.extreme(G.mbr(F.col("g")), "x", True).alias("v"))
    assert plan(d).split("Optimized Logical Plan")[1].split("Physical Plan")[0].count("flatten") <= 20
    assert [r["v"] for r in d.collect()] == [4, 9, 1, None, None]
    assert values(a, a.mbr().as_wkt()) == ["POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POINT (9 9)", "LINESTRING (1 2, 1 5)", None, None]


def test_geometries_to_arrow_and_back():
    some = [W(HOLE), None, W("POINT ZM (1 2 3 4)"), W("POLYGON EMPTY"), W("MULTIPOINT ((1 1), (3 5))")]
    assert G.tuples(G.from_tuples(some)) == some and G.tuples(G.from_tuples(some).slice(2)) == some[2:]
    assert G.tuples(G.from_tuples([])) == [] and G.tuples(G.from_tuples([None])) == [None]


@pytest.mark.parametrize("others", [[], ["POLYGON ((5 0, 9 0, 7 4, 5 0))", HOLE]])
def test_grid_join_of_points_sends_no_side_to_all(spark, others):
    places = [f"POINT ({x / 2} {y / 2})" for x in range(-1, 20) for y in range(-1, 10)]
    areas = [SQUARE, "POLYGON ((2 4, 2 1, 8 1, 8 4, 2 4))", None, *others]
    a, b = indexed(spark, [*places, None]), indexed(spark, areas)
    for p in ("within", "intersects", "touches"):
        d = a.matching(b, p).df
        assert "Broadcast" not in plan(d)
        assert sorted(map(tuple, d.collect())) == [(i, k) for i, q in enumerate(places) for k, g in enumerate(areas) if g and O.predicate(p, W(q), W(g))]
    assert sorted(map(tuple, b.matching(a, "contains").df.collect())) == sorted((k, i) for i, k in map(tuple, a.matching(b, "within").df.collect()))
