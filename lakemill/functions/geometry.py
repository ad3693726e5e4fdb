"""Geometry columns: a struct of type, reference system and parts, with measures and accessors as native expressions.

parts -> rings -> points: a point is one part of one ring of one point, a linestring one ring, a polygon its outer ring and holes; the multi
types have one part for each member. An empty geometry has no parts. Null in, null out.
"""

from __future__ import annotations

import math
import re
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField(c, T.DoubleType()) for c in "xyzm"])
GEOMETRY = T.StructType([T.StructField("gtype", T.StringType()), T.StructField("srid", T.IntegerType()), T.StructField("has_z", T.BooleanType()), T.StructField("has_m", T.BooleanType()), T.StructField("parts", T.ArrayType(T.ArrayType(T.ArrayType(POINT))))])

#: Metres of linear units.
UNITS = {"METER": 1.0, "METRE": 1.0, "KILOMETER": 1000.0, "KILOMETRE": 1000.0, "CENTIMETER": 0.01, "MILLIMETER": 0.001, "FOOT": 0.3048, "YARD": 0.9144, "INCH": 0.0254, "STATUTE MILE": 1609.344, "MILE": 1609.344, "NAUTICAL MILE": 1852.0, "FATHOM": 1.8288, "US SURVEY FOOT": 1200 / 3937, "CLARKE'S FOOT": 0.3047972654, "ROD": 5.0292, "FURLONG": 201.168, "CHAIN": 20.1168, "LINK": 0.201168}
#: Reference systems in degrees, with their names.
GEOGRAPHIC = {4326: "WGS84", 4269: "NAD83", 4258: "ETRS89", 1003: "WGS84_SRS_1003", 1005: "NAD83_SRS_1"}
#: The WGS84 ellipsoid.
A_AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
_R_AUTHALIC = 6371007.1809


def check_unit(unit: str | None) -> float | None:
    """Metres of a unit."""
    if unit is None:
        return None
    if not isinstance(unit, str) or len(unit) > 128:
        raise TypeError("a unit is a text of at most 128 characters")
    if unit.upper() not in UNITS:
        raise ValueError(f"unknown unit {unit!r}")
    return UNITS[unit.upper()]


# Well-known text


def parse_wkt(text: str | None, srid: int = 0):
    """A geometry tuple (gtype, srid, has_z, has_m, parts) from WKT or EWKT, or None."""
    if text is None:
        return None
    if m := re.match(r"\s*SRID=(\d+);", text, re.I):
        srid, text = int(m[1]), text[m.end() :]
    m = re.match(r"\s*([A-Za-z]+)\s*(ZM|Z|M)?\s*(EMPTY|\(.*\))\s*$", text, re.I | re.S)
    if not m:
        raise ValueError(f"not well-known text: {text[:60]!r}")
    kind, dims, rest = m[1].upper(), (m[2] or "").upper(), m[3]
    if kind not in ("POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON"):
        raise ValueError(f"unknown geometry type {kind}")
    if rest.upper() == "EMPTY":
        return (kind, srid, "Z" in dims, "M" in dims, [])
    tree: list = []
    stack = [tree]
    for tok in re.finditer(r"\(|\)|[^(),]+", rest):
        s = tok[0]
        if s == "(":
            stack[-1].append([])
            stack.append(stack[-1][-1])
        elif s == ")":
            stack.pop()
        elif s.strip():
            stack[-1].append([float(v) for v in s.split()])
    body = tree[0]
    n = len(_first_point(body))
    has_z, has_m = ("Z" in dims, "M" in dims) if dims else (n > 2, n > 3)

    def point(v):
        it = iter(v[2:])
        return (v[0], v[1], next(it, None) if has_z else None, next(it, None) if has_m else None)

    ring = lambda r: [point(v) for v in r]
    parts = {
        "POINT": lambda: [[ring(body)]],
        "LINESTRING": lambda: [[ring(body)]],
        "POLYGON": lambda: [[ring(r) for r in body]],
        "MULTIPOINT": lambda: [[[point(v[0] if isinstance(v[0], list) else v)]] for v in body],
        "MULTILINESTRING": lambda: [[ring(r)] for r in body],
        "MULTIPOLYGON": lambda: [[ring(r) for r in p] for p in body],
    }[kind]()
    return (kind, srid, has_z, has_m, parts)


def _first_point(x):
    while isinstance(x[0], list):
        x = x[0]
    return x


def to_wkt(g) -> str | None:
    if g is None:
        return None
    kind, _, has_z, has_m, parts = g
    dims = (" Z" if has_z and not has_m else " ZM" if has_z else " M" if has_m else "")
    num = lambda v: "0" if v is None else f"{v:.15g}"
    pt = lambda p: " ".join(num(v) for v, on in zip(p, (True, True, has_z, has_m), strict=True) if on)
    seq = lambda r: "(" + ", ".join(map(pt, r)) + ")"
    if not parts or not parts[0]:
        return f"{kind}{dims} EMPTY"
    if kind in ("POINT", "LINESTRING"):
        return f"{kind}{dims} {seq(parts[0][0])}"
    if kind == "POLYGON":
        return f"{kind}{dims} (" + ", ".join(map(seq, parts[0])) + ")"
    if kind in ("MULTIPOINT", "MULTILINESTRING"):
        return f"{kind}{dims} (" + ", ".join(seq(p[0]) for p in parts) + ")"
    return f"{kind}{dims} (" + ", ".join("(" + ", ".join(map(seq, p)) + ")" for p in parts) + ")"


def from_wkt(text: Column, srid: int = 0) -> Column:
    return F.udf(lambda s: parse_wkt(s, srid), GEOMETRY, useArrow=True)(text)


def as_wkt(g: Column) -> Column:
    return F.udf(lambda r: to_wkt(None if r is None else (*r[:4], [[[tuple(p) for p in ring] for ring in part] for part in r[4]])), "string", useArrow=True)(g)


def tuples(array: pa.StructArray) -> list:
    """The geometries of an Arrow array as tuples (gtype, srid, has_z, has_m, parts) or None; points are tuples, all above them lists."""
    fields = array.flatten()
    levels, inner = [], fields[4]
    for _ in range(3):
        levels.append(inner.offsets.to_pylist())
        inner = inner.values
    made = list(zip(*[[None] * len(c) if c.null_count == len(c) else c.to_pylist() for c in inner.flatten()], strict=True))
    for ends_ in reversed(levels):
        made = [made[a:b] for a, b in pairwise(ends_)]
    heads = zip(*[f.to_pylist() for f in fields[:4]], strict=True)
    return [(*head, parts) if there else None for head, parts, there in zip(heads, made, array.is_valid().to_pylist(), strict=True)]


def from_tuples(found: list) -> pa.StructArray:
    """tuples() the other way."""
    there = [g is not None for g in found]
    head = lambda k, kind: pa.array([None if g is None else g[k] for g in found], kind)
    items, sizes = [g[4] if g is not None else [] for g in found], []
    for _ in range(3):
        sizes.append(pa.array(accumulate(map(len, items), initial=0), pa.int32()))
        items = [v for i in items for v in i]
    columns = [[p[k] for p in items] for k in range(4)]
    inner = pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in columns], names=list("xyzm"))
    for offsets in reversed(sizes):
        inner = pa.ListArray.from_arrays(offsets, inner)
    return pa.StructArray.from_arrays([head(0, pa.string()), head(1, pa.int32()), head(2, pa.bool_()), head(3, pa.bool_()), inner], names=GEOMETRY.names, mask=pa.array([not t for t in there], pa.bool_()))


def point(x: Column, y: Column, srid: int = 0) -> Column:
    """A point column; null if a coordinate is."""
    p = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(None).cast("double").alias("z"), F.lit(None).cast("double").alias("m"))
    g = F.struct(F.lit("POINT").alias("gtype"), F.lit(srid).alias("srid"), F.lit(False).alias("has_z"), F.lit(False).alias("has_m"), F.array(F.array(F.array(p))).alias("parts"))
    return F.when(x.isNotNull() & y.isNotNull(), g).cast(GEOMETRY)


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column, srid: Column | int = 0) -> Column:
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(None).cast("double").alias("z"), F.lit(None).cast("double").alias("m"))
    ring = F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1), p(x0, y0))
    s = srid if isinstance(srid, Column) else F.lit(srid)
    g = F.struct(F.lit("POLYGON").alias("gtype"), s.alias("srid"), F.lit(False).alias("has_z"), F.lit(False).alias("has_m"), F.array(F.array(ring)).alias("parts"))
    return F.when(x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull(), g).cast(GEOMETRY)


# Accessors


def _let(value: Column, of) -> Column:
    """of(value), with the value found once however often `of` names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def points(g: Column) -> Column:
    return F.flatten(F.flatten(g["parts"]))


def is_empty(g: Column) -> Column:
    return F.when(g.isNotNull(), (F.size(points(g)) == 0).cast("int"))


def _filled(g: Column, value: Column) -> Column:
    return F.when(g.isNotNull() & (F.size(points(g)) > 0), value)


def extreme(g: Column, axis: str, largest: bool) -> Column:
    """Null without points, as nulls are passed over."""
    v = points(g)[axis]
    return F.array_max(v) if largest else F.array_min(v)


def coordinate(g: Column, axis: str) -> Column:
    return F.get(points(g), F.lit(0))[axis]


def ends(g: Column) -> Column:
    """The box of a geometry as a struct."""
    return F.struct(*[extreme(g, axis, end == "b").alias(f"{axis}{end}") for axis in "xy" for end in "ab"])


def is_box(g: Column) -> Column:
    """Whether an area is one rectangle along the axes, and so the same as its box; null for null."""
    turns = lambda u, v: (u[0] == u[1]) & (v[1] == v[2]) & (u[2] == u[3]) & (v[3] == v[0])

    def of(ring: Column) -> Column:
        x, y = ([F.get(ring, F.lit(k))[axis] for k in range(5)] for axis in "xy")
        return (x[0] == x[4]) & (y[0] == y[4]) & (x[0] != x[2]) & (y[0] != y[2]) & (turns(x, y) | turns(y, x))

    whole = (F.size(g["parts"]) == 1) & (F.size(F.get(g["parts"], F.lit(0))) == 1) & (F.size(points(g)) == 5) & g["gtype"].endswith("POLYGON")
    return F.when(g.isNotNull(), F.coalesce(whole & _let(points(g), of), F.lit(False)))


def _boxed(g: Column, of) -> Column:
    """of(the box with the reference system), the geometry and its box each found once; null without points."""
    box = lambda g: F.when(F.size(points(g)) > 0, F.struct(g["srid"].alias("srid"), ends(g)["xa"].alias("xa"), ends(g)["ya"].alias("ya"), ends(g)["xb"].alias("xb"), ends(g)["yb"].alias("yb")))
    return _let(_let(g, box), lambda b: F.when(b.isNotNull(), of(b)))


def mbr(g: Column) -> Column:
    """The smallest rectangle; a point for a point, a line for an axis-parallel one."""
    none = F.lit(None).cast("double")
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"), none.alias("z"), none.alias("m"))

    def of(box: Column) -> Column:
        x0, y0, x1, y1 = (box[c] for c in ("xa", "ya", "xb", "yb"))
        line = F.struct(F.lit("LINESTRING").alias("gtype"), box["srid"].alias("srid"), F.lit(False).alias("has_z"), F.lit(False).alias("has_m"), F.array(F.array(F.array(p(x0, y0), p(x1, y1)))).alias("parts")).cast(GEOMETRY)
        return F.when((x0 == x1) & (y0 == y1), point(x0, y0)).when((x0 == x1) | (y0 == y1), line).otherwise(rectangle(x0, y0, x1, y1, box["srid"]))

    return _boxed(g, of)


def envelope(g: Column, edge: float = 1e-6) -> Column:
    """Always a polygon: a degenerate box is enlarged a little."""

    def of(box: Column) -> Column:
        x0, y0, x1, y1 = (box[c] for c in ("xa", "ya", "xb", "yb"))
        dx, dy = F.when(x0 == x1, F.lit(edge)).otherwise(0.0), F.when(y0 == y1, F.lit(edge)).otherwise(0.0)
        return rectangle(x0 - dx, y0 - dy, x1 + dx, y1 + dy, box["srid"])

    return _boxed(g, of)


def centroid(g: Column) -> Column:
    """The centre of the smallest rectangle."""
    mid = lambda a: (extreme(g, a, False) + extreme(g, a, True)) / 2
    return _filled(g, point(mid("x"), mid("y")))


def part_as(g: Column, gtype: str, ring_points: Column) -> Column:
    return F.struct(F.lit(gtype).alias("gtype"), g["srid"].alias("srid"), g["has_z"].alias("has_z"), g["has_m"].alias("has_m"), F.array(F.array(ring_points)).alias("parts")).cast(GEOMETRY)


def exterior_ring(g: Column) -> Column:
    return _filled(g, part_as(g, "LINESTRING", F.get(F.get(g["parts"], F.lit(0)), F.lit(0))))


def end_point(g: Column, last: bool) -> Column:
    p = points(g)
    return _filled(g, part_as(g, "POINT", F.array(F.element_at(p, -1 if last else 1))))


def geometry_type(g: Column) -> Column:
    return F.when(g.isNotNull(), F.concat(F.lit("ST_"), g["gtype"]))


def dimension(g: Column) -> Column:
    d = F.when(g["gtype"].endswith("POINT"), 0).when(g["gtype"].endswith("LINESTRING"), 1).otherwise(2)
    return F.when(g.isNotNull(), F.when(F.size(points(g)) == 0, -1).otherwise(d))


def coord_dim(g: Column) -> Column:
    return F.when(g.isNotNull(), 2 + g["has_z"].cast("int") + g["has_m"].cast("int"))


def flag(g: Column, of: str) -> Column:
    return _filled(g, g[of].cast("int"))


def count_of(g: Column, what: str) -> Column:
    """points, parts or holes."""
    n = {"points": F.size(points(g)), "parts": F.size(g["parts"]), "holes": F.size(F.get(g["parts"], F.lit(0))) - 1}[what]
    return _filled(g, n)


def is_closed(g: Column) -> Column:
    ends = F.forall(F.flatten(g["parts"]), lambda r: F.get(r, F.lit(0)).eqNullSafe(F.element_at(r, -1)))
    return _filled(g, ends.cast("int"))


# Measures


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _edges(ring: Column, of) -> Column:
    return F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), of)


def lambert(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Metres between two places in degrees on the WGS84 ellipsoid, by Lambert's formula."""
    f = FLATTENING
    b1, b2 = (F.atan((1 - f) * F.tan(F.radians(y))) for y in (y1, y2))
    h = F.pow(F.sin((b2 - b1) / 2), 2.0) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(F.radians(x2 - x1) / 2), 2.0)
    s = 2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x = (s - F.sin(s)) * F.pow(F.sin(p) * F.cos(q), 2.0) / F.greatest(F.pow(F.cos(s / 2), 2.0), F.lit(1e-300))
    y = (s + F.sin(s)) * F.pow(F.cos(p) * F.sin(q), 2.0) / F.greatest(F.pow(F.sin(s / 2), 2.0), F.lit(1e-300))
    return F.when((x1 == x2) & (y1 == y2), 0.0).otherwise(A_AXIS * (s - f / 2 * (x + y)))


def _in_degrees(g: Column) -> Column:
    return g["srid"].isin(*GEOGRAPHIC)


def length(g: Column, unit: str | None = None) -> Column:
    """Of all rings: the length of lines, the perimeter of polygons. Without a unit, in that of the reference system."""
    return _let(g, lambda g: _length(g, check_unit(unit)))


def _length(g: Column, m: float | None) -> Column:
    rings = F.flatten(g["parts"])
    flat = _sum(F.flatten(F.transform(rings, lambda r: _edges(r, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])))))
    if m is None:
        return _filled(g, flat)
    earth = _sum(F.flatten(F.transform(rings, lambda r: _edges(r, lambda a, b: lambert(a["x"], a["y"], b["x"], b["y"])))))
    return _filled(g, F.when(_in_degrees(g), earth).otherwise(flat) / m)


def area(g: Column, unit: str | None = None) -> Column:
    """Outer rings less holes; 0 for points and lines. With a unit, degrees are taken to the sphere of the ellipsoid's area."""
    return _let(g, lambda g: _area(g, check_unit(unit)))


def _area(g: Column, m: float | None) -> Column:
    def of(edge) -> Column:
        rings = F.transform(g["parts"], lambda part: F.transform(part, lambda r, k: F.when(k == 0, 1).otherwise(-1) * F.abs(_sum(_edges(r, edge)))))
        return F.when(g["gtype"].endswith("POLYGON"), _sum(F.flatten(rings))).otherwise(0.0)

    flat = of(lambda a, b: (a["x"] * b["y"] - b["x"] * a["y"]) / 2)
    if m is None:
        return _filled(g, flat)
    earth = of(lambda a, b: F.radians(b["x"] - a["x"]) * (2 + F.sin(F.radians(a["y"])) + F.sin(F.radians(b["y"]))) / 2 * _R_AUTHALIC**2)
    return _filled(g, F.when(_in_degrees(g), earth).otherwise(flat) / m**2)


def mbr_intersects(a: Column, b: Column) -> Column:
    return boxes_meet(ends(a), ends(b)).cast("int")


def boxes_meet(p: Column, q: Column) -> Column:
    """Of two ends()."""
    return (p["xa"] <= q["xb"]) & (q["xa"] <= p["xb"]) & (p["ya"] <= q["yb"]) & (q["ya"] <= p["yb"])


def locate(p: Column, g: Column) -> Column:
    """Where a point is in an area: 1 inside, 0 on its boundary, -1 outside; null if either is null or empty."""
    return _filled(p, place(coordinate(p, "x"), coordinate(p, "y"), g))


def place_in_box(x: Column, y: Column, box: list[Column]) -> Column:
    """locate() for a rectangle along the axes with these ends (xa, xb, ya, yb)."""
    xa, xb, ya, yb = box
    return F.when((x > xa) & (x < xb) & (y > ya) & (y < yb), 1).when((x >= xa) & (x <= xb) & (y >= ya) & (y <= yb), 0).otherwise(-1)


def place(x: Column, y: Column, g: Column) -> Column:
    """locate() for a point's coordinates."""

    def at(part: Column) -> Column:
        edges = F.flatten(F.transform(part, lambda r: _edges(r, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))))
        on = lambda e: ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"])) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        # A ray to the right meets the boundary an odd number of times from inside.
        right = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & F.coalesce(x < F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]) + e["x1"], F.lit(False))
        return F.when(F.exists(edges, on), 0).when(F.size(F.filter(edges, right)) % 2 == 1, 1).otherwise(-1)

    return _filled(g, F.array_max(F.transform(g["parts"], at)))


def point_distance(a: Column, b: Column, unit: str | None = None) -> Column:
    """Between two points."""
    return distance_of(spot(a), spot(b), unit)


def spot(p: Column) -> Column:
    """What distances need of a point."""
    return F.struct(coordinate(p, "x").alias("x"), coordinate(p, "y").alias("y"), p["srid"].alias("srid"))


def distance_of(a: Column, b: Column, unit: str | None = None) -> Column:
    """Between two spot()s."""
    m = check_unit(unit)
    x1, y1, x2, y2 = a["x"], a["y"], b["x"], b["y"]
    flat = F.hypot(x2 - x1, y2 - y1)
    return flat if m is None else F.when(_in_degrees(a), lambert(x1, y1, x2, y2)).otherwise(flat) / m


def earth_distance(x1: float, y1: float, x2: float, y2: float) -> float:
    """lambert() for numbers."""
    if (x1, y1) == (x2, y2):
        return 0.0
    f = FLATTENING
    b1, b2 = (math.atan((1 - f) * math.tan(math.radians(y))) for y in (y1, y2))
    h = math.sin((b2 - b1) / 2) ** 2 + math.cos(b1) * math.cos(b2) * math.sin(math.radians(x2 - x1) / 2) ** 2
    s = 2 * math.asin(min(1.0, math.sqrt(h)))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x = (s - math.sin(s)) * (math.sin(p) * math.cos(q)) ** 2 / max(math.cos(s / 2) ** 2, 1e-300)
    y = (s + math.sin(s)) * (math.cos(p) * math.sin(q)) ** 2 / max(math.sin(s / 2) ** 2, 1e-300)
    return A_AXIS * (s - f / 2 * (x + y))
