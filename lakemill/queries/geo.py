"""Geometry, on points and rectangles that the tables' numbers give."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..plans.geoframe import GeoFrame
from ..plans.shared import spread
from . import query, rounded


def _points(t, srid: int = 0) -> GeoFrame:
    d = spread(t("customer").df.select("c_custkey", "c_acctbal"))
    return GeoFrame(d.select("c_custkey", G.point(F.col("c_acctbal") / 100, F.col("c_custkey") % 90, srid).alias("g")), geometry="g")


def _boxes(t) -> GeoFrame:
    d = spread(t("part").df.select("p_partkey", "p_retailprice", "p_size"))
    x, y = F.col("p_retailprice") / 100, F.col("p_partkey") % 90
    return GeoFrame(d.select("p_partkey", G.rectangle(x, y, x + F.col("p_size") / 10 + 0.05, y + 2.5).alias("g")), geometry="g")


P = "(SELECT c_custkey, c_acctbal / 100 AS x, (c_custkey % 90)::DOUBLE AS y FROM customer)"
B = "(SELECT p_partkey, p_retailprice / 100 AS x0, (p_partkey % 90)::DOUBLE AS y0, p_retailprice / 100 + p_size / 10 + 0.05 AS x1, p_partkey % 90 + 2.5 AS y1 FROM part)"


def _with(f: GeoFrame, id_: str, **out) -> object:
    d = f.base
    g = F.col("g")
    return rounded(d.select(id_, *[of(g).alias(k) for k, of in out.items()]))


query("geo_point_xy", f"SELECT c_custkey, round(x, 6) AS x, round(y, 6) AS y FROM {P}")(lambda t: _with(_points(t), "c_custkey", x=lambda g: G.coordinate(g, "x"), y=lambda g: G.coordinate(g, "y")))
query("geo_area", f"SELECT p_partkey, round((x1 - x0) * (y1 - y0), 6) AS area, round(2 * (x1 - x0 + y1 - y0), 6) AS perimeter FROM {B}")(lambda t: _with(_boxes(t), "p_partkey", area=G.area, perimeter=G.length))
query("geo_mbr", f"SELECT p_partkey, round(x0, 6) AS min_x, round(x1, 6) AS max_x, round(y0, 6) AS min_y, round(y1, 6) AS max_y FROM {B}")(
    lambda t: _with(_boxes(t), "p_partkey", min_x=lambda g: G.extreme(G.mbr(g), "x", False), max_x=lambda g: G.extreme(G.mbr(g), "x", True), min_y=lambda g: G.extreme(G.mbr(g), "y", False), max_y=lambda g: G.extreme(G.mbr(g), "y", True))
)
query("geo_centroid", f"SELECT p_partkey, round((x0 + x1) / 2, 6) AS x, round((y0 + y1) / 2, 6) AS y FROM {B}")(lambda t: _with(_boxes(t), "p_partkey", x=lambda g: G.coordinate(G.centroid(g), "x"), y=lambda g: G.coordinate(G.centroid(g), "y")))
query("geo_counts", f"SELECT p_partkey, 5 AS points, 0 AS holes, 2 AS dimension, 0 AS empty, 'ST_POLYGON' AS gtype FROM {B}")(lambda t: _with(_boxes(t), "p_partkey", points=lambda g: G.count_of(g, "points"), holes=lambda g: G.count_of(g, "holes"), dimension=G.dimension, empty=G.is_empty, gtype=G.geometry_type))
query("geo_length", "SELECT o_orderkey, round(sqrt(power(o_totalprice / 1000, 2) + 9) + 4, 6) AS length, 1 AS dimension FROM orders")(
    lambda t: rounded(t("orders").df.select("o_orderkey", _line(F.col("o_totalprice") / 1000).alias("g")).select("o_orderkey", G.length(F.col("g")).alias("length"), G.dimension(F.col("g")).alias("dimension")))
)


def _line(x):
    none = F.lit(None).cast("double")
    p = lambda a, b: F.struct(F.lit(a).cast("double").alias("x") if isinstance(a, (int, float)) else a.alias("x"), F.lit(float(b)).alias("y"), none.alias("z"), none.alias("m"))
    return F.struct(F.lit("LINESTRING").alias("gtype"), F.lit(0).alias("srid"), F.lit(False).alias("has_z"), F.lit(False).alias("has_m"), F.array(F.array(F.array(p(0.0, 0), p(x, 3), p(x, 7)))).alias("parts")).cast(G.GEOMETRY)


@query("geo_distance", f"SELECT c_custkey AS \"INDEXERIDA1\", n_nationkey AS \"INDEXERIDA2\", round(sqrt(power(x - n_nationkey, 2) + power(y - n_regionkey, 2)), 6) AS \"RESULT\" FROM {P} CROSS JOIN nation")
def _(t):
    a = _points(t)
    b = GeoFrame(t("nation").df.select("n_nationkey", G.point(F.col("n_nationkey"), F.col("n_regionkey")).alias("g")), geometry="g")
    a.index, b.index = "c_custkey", "n_nationkey"
    return rounded(a.distance(b).df)


@query("geo_within", f"SELECT c_custkey AS \"INDEXERIDA1\", p_partkey AS \"INDEXERIDA2\" FROM {P} JOIN {B} ON x > x0 AND x < x1 AND y > y0 AND y < y1")
def _(t):
    a, b = _points(t), _boxes(t)
    a.index, b.index = "c_custkey", "p_partkey"
    return a.matching(b, "within")


@query("geo_mbr_intersects", f"SELECT p_partkey AS \"INDEXERIDA1\", n_nationkey AS \"INDEXERIDA2\", (x0 <= n_nationkey + 3 AND x1 >= n_nationkey AND y0 <= n_regionkey + 3 AND y1 >= n_regionkey)::INT AS \"RESULT\" FROM {B} CROSS JOIN nation")
def _(t):
    a = _boxes(t)
    x, y = F.col("n_nationkey"), F.col("n_regionkey")
    b = GeoFrame(t("nation").df.select("n_nationkey", G.rectangle(x, y, x + 3, y + 3).alias("g")), geometry="g")
    a.index, b.index = "p_partkey", "n_nationkey"
    return a.mbr_intersects(b)


@query("geo_intersection_area", f"SELECT p_partkey, round(greatest(least(x1, 16) - greatest(x0, 10), 0) * greatest(least(y1, 40) - greatest(y0, 20), 0), 6) AS area FROM {B} WHERE x0 <= 16 AND x1 >= 10 AND y0 <= 40 AND y1 >= 20")
def _(t):
    from functools import partial

    from ..functions import overlay as O
    from ..plans.geoframe import _udf

    d = _boxes(t).base
    box = G.rectangle(F.lit(10), F.lit(20), F.lit(16), F.lit(40))
    hit = d.where(G.mbr_intersects(F.col("g"), box) == 1)
    return rounded(hit.select("p_partkey", G.area(_udf(partial(O.combine, "intersection"))(F.col("g"), box)).alias("area")).select("p_partkey", F.coalesce("area", F.lit(0.0)).alias("area")))


# Pairs of rectangles: nations' against regions'

N = "(SELECT n_nationkey, n_nationkey AS ax0, n_regionkey AS ay0, n_nationkey + 3 AS ax1, n_regionkey + 3 AS ay1 FROM nation)"
R = "(SELECT r_regionkey, r_regionkey * 5 AS bx0, r_regionkey AS by0, r_regionkey * 5 + 3 + (r_regionkey % 2) * 2 AS bx1, r_regionkey + 3 + (r_regionkey % 2) AS by1 FROM region)"


def _nations(t) -> GeoFrame:
    x, y = F.col("n_nationkey"), F.col("n_regionkey")
    out = GeoFrame(t("nation").df.select("n_nationkey", G.rectangle(x, y, x + 3, y + 3).alias("g")), geometry="g")
    out.index = "n_nationkey"
    return out


def _regions(t) -> GeoFrame:
    r = F.col("r_regionkey")
    out = GeoFrame(t("region").df.select("r_regionkey", G.rectangle(r * 5, r, r * 5 + 3 + r % 2 * 2, r + 3 + r % 2).alias("g")), geometry="g")
    out.index = "r_regionkey"
    return out


_INNER, _MEET = "ax0 < bx1 AND bx0 < ax1 AND ay0 < by1 AND by0 < ay1", "ax0 <= bx1 AND bx0 <= ax1 AND ay0 <= by1 AND by0 <= ay1"
_IN, _OVER = "ax0 >= bx0 AND ax1 <= bx1 AND ay0 >= by0 AND ay1 <= by1", "ax0 <= bx0 AND ax1 >= bx1 AND ay0 <= by0 AND ay1 >= by1"
for _p, _sql in {
    "equals": f"{_IN} AND {_OVER}",
    "intersects": _MEET,
    "disjoint": f"NOT ({_MEET})",
    "touches": f"{_MEET} AND NOT ({_INNER})",
    "within": _IN,
    "contains": _OVER,
    "overlaps": f"{_INNER} AND NOT ({_IN}) AND NOT ({_OVER})",
}.items():
    query(f"geo_{_p}_pairs", f"SELECT n_nationkey AS \"INDEXERIDA1\", r_regionkey AS \"INDEXERIDA2\", ({_sql})::INT AS \"RESULT\" FROM {N} CROSS JOIN {R}")(lambda t, p=_p: getattr(_nations(t), p)(_regions(t)))
for _p, _sql in {
    "within": "x > ax0 AND x < ax1 AND y > ay0 AND y < ay1",
    "intersects": "x >= ax0 AND x <= ax1 AND y >= ay0 AND y <= ay1",
    "touches": "x >= ax0 AND x <= ax1 AND y >= ay0 AND y <= ay1 AND (x = ax0 OR x = ax1 OR y = ay0 OR y = ay1)",
    "disjoint": "x < ax0 OR x > ax1 OR y < ay0 OR y > ay1",
}.items():
    query(f"geo_point_{_p}", f"SELECT s_suppkey AS \"INDEXERIDA1\", n_nationkey AS \"INDEXERIDA2\", ({_sql})::INT AS \"RESULT\" FROM (SELECT s_suppkey, s_suppkey % 30 AS x, s_nationkey % 8 AS y FROM supplier) CROSS JOIN {N}")(lambda t, p=_p: getattr(_suppliers(t), p)(_nations(t)))
query("geo_area_contains", f"SELECT n_nationkey AS \"INDEXERIDA1\", s_suppkey AS \"INDEXERIDA2\", (x > ax0 AND x < ax1 AND y > ay0 AND y < ay1)::INT AS \"RESULT\" FROM {N} CROSS JOIN (SELECT s_suppkey, s_suppkey % 30 AS x, s_nationkey % 8 AS y FROM supplier)")(lambda t: _nations(t).contains(_suppliers(t)))


def _suppliers(t) -> GeoFrame:
    out = GeoFrame(t("supplier").df.select("s_suppkey", G.point(F.col("s_suppkey") % 30, F.col("s_nationkey") % 8).alias("g")), geometry="g")
    out.index = "s_suppkey"
    return out


@query("geo_crosses_pairs", f"SELECT r_regionkey AS \"INDEXERIDA1\", n_nationkey AS \"INDEXERIDA2\", (y > ay0 AND y < ay1 AND x0 < ax1 AND x1 > ax0 AND NOT (x0 >= ax0 AND x1 <= ax1))::INT AS \"RESULT\" FROM (SELECT r_regionkey, r_regionkey + 1.5 AS y, r_regionkey * 4 - 1 AS x0, r_regionkey * 4 + 1 AS x1 FROM region) CROSS JOIN {N}")
def _(t):
    r = F.col("r_regionkey")
    lines = GeoFrame(t("region").df.select("r_regionkey", _path((r * 4 - 1, r + 1.5), (r * 4 + 1, r + 1.5)).alias("g")), geometry="g")
    lines.index = "r_regionkey"
    return lines.crosses(_nations(t))


def _path(*places):
    none = F.lit(None).cast("double")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), none.alias("z"), none.alias("m"))
    return F.struct(F.lit("LINESTRING").alias("gtype"), F.lit(0).alias("srid"), F.lit(False).alias("has_z"), F.lit(False).alias("has_m"), F.array(F.array(F.array(*[point(x, y) for x, y in places]))).alias("parts")).cast(G.GEOMETRY)


_CUT = "greatest(least(ax1, bx1) - greatest(ax0, bx0), 0) * greatest(least(ay1, by1) - greatest(ay0, by0), 0)"
for _o, _sql in {"intersection": _CUT, "union": f"(ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - {_CUT}", "difference": f"(ax1 - ax0) * (ay1 - ay0) - {_CUT}"}.items():
    query(f"geo_{_o}_pairs", f"SELECT n_nationkey AS \"INDEXERIDA1\", r_regionkey AS \"INDEXERIDA2\", round(({_sql})::DOUBLE, 6) AS area FROM {N} CROSS JOIN {R}")(
        lambda t, o=_o: rounded(getattr(_nations(t), o)(_regions(t)).df.select("INDEXERIDA1", "INDEXERIDA2", F.coalesce(G.area(F.col("RESULT")), F.lit(0.0)).alias("area")))
    )
query("geo_box_distance", f"SELECT n_nationkey AS \"INDEXERIDA1\", r_regionkey AS \"INDEXERIDA2\", round(sqrt(power(greatest(ax0 - bx1, bx0 - ax1, 0), 2) + power(greatest(ay0 - by1, by0 - ay1, 0), 2)), 6) AS \"RESULT\" FROM {N} CROSS JOIN {R}")(lambda t: rounded(_nations(t).distance(_regions(t)).df))

# Accessors


def _measured(f: GeoFrame, id_: str, **out) -> object:
    """Series of one geometry column, side by side."""
    cols = {id_: F.col(id_)} | {k: next(iter(of(f.geometry).cols.values())) for k, of in out.items()}
    return rounded(f.base.select(*[e.alias(k) for k, e in cols.items()]))


def _lines(t) -> GeoFrame:
    x = F.col("o_totalprice") / 1000
    return GeoFrame(t("orders").df.select("o_orderkey", _path((F.lit(0), F.lit(0)), (x, F.lit(3)), (x, F.lit(7))).alias("g")), geometry="g")


query("geo_line_ends", "SELECT o_orderkey, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, round(o_totalprice / 1000, 6) AS x1, 7.0::DOUBLE AS y1, 0 AS closed, 1 AS simple, 3 AS points FROM orders")(
    lambda t: _measured(_lines(t), "o_orderkey", x0=lambda g: g.start_point().x(), y0=lambda g: g.start_point().y(), x1=lambda g: g.end_point().x(), y1=lambda g: g.end_point().y(), closed=lambda g: g.is_closed(), simple=lambda g: g.is_simple(), points=lambda g: g.num_points())
)
query("geo_box_accessors", f"SELECT p_partkey, round((x1 - x0) * (y1 - y0), 6) AS envelope, round(2 * (x1 - x0 + y1 - y0), 6) AS ring, round((x1 - x0) * (y1 - y0), 6) AS hull, 1 AS valid, 1 AS edge, 0 AS srid, 'DEFAULT_SRS' AS srs, 2 AS dims, 0 AS z, 0 AS m FROM {B}")(
    lambda t: _measured(_boxes(t), "p_partkey", envelope=lambda g: g.envelope().area(), ring=lambda g: g.exterior_ring().length(), hull=lambda g: g.convex_hull().area(), valid=lambda g: g.is_valid(), edge=lambda g: g.boundary().dimension(), srid=lambda g: g.srid(), srs=lambda g: g.srs_name(), dims=lambda g: g.coord_dim(), z=lambda g: g.is_3d(), m=lambda g: g.is_measured())
)
query("geo_generalize", f"SELECT p_partkey, round((x1 - x0) * (y1 - y0), 6) AS area FROM {B}")(lambda t: _measured(_boxes(t), "p_partkey", area=lambda g: g.generalize(0).area()))
query("geo_mid_point", "SELECT n_nationkey, (n_nationkey + 1)::DOUBLE AS x, 2.0::DOUBLE AS y FROM nation")(
    lambda t: _measured(GeoFrame(t("nation").df.select("n_nationkey", _path((F.col("n_nationkey"), F.lit(2)), (F.col("n_nationkey") + 2, F.lit(2))).alias("g")), geometry="g"), "n_nationkey", x=lambda g: g.mid_point().x(), y=lambda g: g.mid_point().y())
)


def _point_zm(t) -> GeoFrame:
    n = F.col("n_nationkey").cast("double")
    place = F.struct(n.alias("x"), (n + 1).alias("y"), (n + 2).alias("z"), (n + 3).alias("m"))
    return GeoFrame(t("nation").df.select("n_nationkey", F.struct(F.lit("POINT").alias("gtype"), F.lit(4326).alias("srid"), F.lit(True).alias("has_z"), F.lit(True).alias("has_m"), F.array(F.array(F.array(place))).alias("parts")).cast(G.GEOMETRY).alias("g")), geometry="g")


query("geo_point_zm", "SELECT n_nationkey, n_nationkey + 2.0::DOUBLE AS z, n_nationkey + 3.0::DOUBLE AS m, n_nationkey + 2.0::DOUBLE AS max_z, n_nationkey + 3.0::DOUBLE AS max_m, n_nationkey + 2.0::DOUBLE AS min_z, n_nationkey + 3.0::DOUBLE AS min_m, 1 AS has_z, 1 AS has_m, 4 AS dims, 'WGS84' AS srs FROM nation")(
    lambda t: _measured(_point_zm(t), "n_nationkey", z=lambda g: g.z(), m=lambda g: g.m(), max_z=lambda g: g.max_z(), max_m=lambda g: g.max_m(), min_z=lambda g: g.min_z(), min_m=lambda g: g.min_m(), has_z=lambda g: g.is_3d(), has_m=lambda g: g.is_measured(), dims=lambda g: g.coord_dim(), srs=lambda g: g.srs_name())
)


def _multi(t, gtype: str) -> GeoFrame:
    n = F.col("n_nationkey")
    one = (lambda x: G.rectangle(x, F.lit(0), x + 1, F.lit(1))) if gtype == "MULTIPOLYGON" else (lambda x: _path((x, F.lit(0)), (x + 1, F.lit(1))))
    a, b = one(n), one(n + 5)
    return GeoFrame(t("nation").df.select("n_nationkey", F.struct(F.lit(gtype).alias("gtype"), F.lit(0).alias("srid"), F.lit(False).alias("has_z"), F.lit(False).alias("has_m"), F.concat(a["parts"], b["parts"]).alias("parts")).cast(G.GEOMETRY).alias("g")), geometry="g")


query("geo_multi_polygons", "SELECT n_nationkey, 2 AS parts, 2 AS polygons, 2.0::DOUBLE AS area FROM nation")(lambda t: _measured(_multi(t, "MULTIPOLYGON"), "n_nationkey", parts=lambda g: g.num_geometries(), polygons=lambda g: g.num_polygons(), area=lambda g: g.area()))
query("geo_multi_lines", "SELECT n_nationkey, 2 AS parts, 2 AS lines, round(2 * sqrt(2), 6) AS length FROM nation")(lambda t: _measured(_multi(t, "MULTILINESTRING"), "n_nationkey", parts=lambda g: g.num_geometries(), lines=lambda g: g.num_line_strings(), length=lambda g: g.length()))


@query("geo_buffer", "SELECT n_nationkey, 1 AS around, 1 AS near FROM nation")
def _(t):
    """The area of a round buffer is within a hundredth of the disc's."""
    n = F.col("n_nationkey")
    f = GeoFrame(t("nation").df.select("n_nationkey", G.point(n, n).alias("g")), geometry="g")
    d = _measured(f, "n_nationkey", area=lambda g: g.buffer(2).area(), far=lambda g: g.buffer(2).max_x())
    return d.select("n_nationkey", (F.abs(F.col("area") / (4 * F.pi()) - 1) < 0.01).cast("int").alias("around"), (F.abs(F.col("far") - F.col("n_nationkey") - 2) < 0.01).cast("int").alias("near"))
