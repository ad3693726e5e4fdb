"""Geo frames: a frame with a geometry column, whose measures it forwards to, and operations between two geo frames."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import overlay as O
from ..operators.stats import name
from .frame import Frame, FrameError, Series

PREDICATES = ("equals", "crosses", "intersects", "overlaps", "touches", "disjoint", "contains", "within")
LINES, AREAS = ("LINESTRING", "MULTILINESTRING"), ("POLYGON", "MULTIPOLYGON")


def _udf(of, kind=G.GEOMETRY):
    """A function of geometry tuples as a function of columns; null if an argument is. Rows come and go as Arrow arrays, not as Spark's rows."""
    value = None if kind is G.GEOMETRY else {"int": pa.int32(), "double": pa.float64()}[kind]

    def run(*arrays: pa.Array) -> pa.Array:
        found = [None if any(x is None for x in a) else of(*a) for a in zip(*map(G.tuples, arrays), strict=True)]
        return G.from_tuples(found) if value is None else pa.array(found, value)

    return F.arrow_udf(run, kind)


class GeoSeries(Series):
    """One geometry column. Measures are series; null in, null out. types: what the column may hold is checked where a measure needs it."""

    def min(self):
        raise TypeError("geometries have no order")

    max = min

    def _map(self, of, types: tuple[str, ...] | None = None, geo: bool = False) -> Series:
        (c, e), = self.cols.items()
        if types is not None:
            # A value of another type is an error of its row, found when the plan runs.
            e = F.when(e.isNull() | e["gtype"].isin(*types), e).otherwise(F.raise_error(F.lit(f"a geometry is none of {', '.join(types)}")).cast(G.GEOMETRY))
        out = self._new(cols={c: of(e)}, series=True)
        out.__class__ = GeoSeries if geo else Series
        return out

    def _number(self, value, what: str, least: float | None = None) -> float:
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise TypeError(f"{what} must be a number")
        if least is not None and value < least:
            raise ValueError(f"{what} must be at least {least}")
        return float(value)

    # Geometries

    def generalize(self, threshold: float) -> GeoSeries:
        t = self._number(threshold, "threshold", 0)
        return self._map(_udf(partial(O.generalize, threshold=t)), geo=True)

    def buffer(self, distance: float, unit: str | None = None) -> GeoSeries:
        """With a unit, degrees are taken as 111 195 metres each."""
        d, m = self._number(distance, "distance"), G.check_unit(unit)
        return self._map(_udf(lambda g: O.buffer(g, d if m is None else d * m / (111_195.0 if g[1] in G.GEOGRAPHIC else 1.0))), geo=True)

    centroid = lambda self: self._map(G.centroid, geo=True)
    convex_hull = lambda self: self._map(_udf(O.hull), geo=True)
    boundary = lambda self: self._map(_udf(O.boundary), geo=True)
    envelope = lambda self: self._map(G.envelope, geo=True)
    mbr = lambda self: self._map(G.mbr, geo=True)
    exterior_ring = lambda self: self._map(G.exterior_ring, ("POLYGON",), geo=True)
    start_point = lambda self: self._map(lambda g: G.end_point(g, False), ("LINESTRING",), geo=True)
    end_point = lambda self: self._map(lambda g: G.end_point(g, True), ("LINESTRING",), geo=True)
    mid_point = lambda self: self._map(_udf(O.mid_point), ("LINESTRING",), geo=True)

    # Values

    srid = lambda self: self._map(lambda g: g["srid"])
    geometry_type = lambda self: self._map(G.geometry_type)
    area = lambda self, unit=None: self._map(lambda g: G.area(g, unit))
    length = lambda self, unit=None: self._map(lambda g: G.length(g, unit), LINES)
    perimeter = lambda self, unit=None: self._map(lambda g: G.length(g, unit), AREAS)
    dimension = lambda self: self._map(G.dimension)
    coord_dim = lambda self: self._map(G.coord_dim)
    is_3d = lambda self: self._map(lambda g: G.flag(g, "has_z"))
    is_measured = lambda self: self._map(lambda g: G.flag(g, "has_m"))
    is_valid = lambda self: self._map(_udf(O.is_valid, "int"))
    is_simple = lambda self: self._map(_udf(O.is_simple, "int"))
    is_empty = lambda self: self._map(G.is_empty)
    is_closed = lambda self: self._map(G.is_closed, LINES)
    num_geometries = lambda self: self._map(lambda g: G.count_of(g, "parts"), ("MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON"))
    num_interior_ring = lambda self: self._map(lambda g: G.count_of(g, "holes"), ("POLYGON",))
    num_line_strings = lambda self: self._map(lambda g: G.count_of(g, "parts"), ("MULTILINESTRING",))
    num_polygons = lambda self: self._map(lambda g: G.count_of(g, "parts"), ("MULTIPOLYGON",))
    num_points = lambda self: self._map(lambda g: G.count_of(g, "points"))
    as_wkt = lambda self: self._map(G.as_wkt)

    def srs_name(self) -> Series:
        names = F.create_map(*[F.lit(v) for p in G.GEOGRAPHIC.items() for v in p])
        return self._map(lambda g: F.when(g.isNotNull(), F.coalesce(names[g["srid"]], F.lit("DEFAULT_SRS"))))


for _a in "xyzm":
    setattr(GeoSeries, _a, lambda self, a=_a: self._map(lambda g: G.coordinate(g, a), ("POINT",)))
    setattr(GeoSeries, f"max_{_a}", lambda self, a=_a: self._map(lambda g: G.extreme(g, a, True)))
    setattr(GeoSeries, f"min_{_a}", lambda self, a=_a: self._map(lambda g: G.extreme(g, a, False)))


class GeoFrame(Frame):
    """A frame with a designated geometry column. What it doesn't know itself is asked of that column."""

    def __init__(self, base: DataFrame, cols=None, index: str | None = None, geometry: str | None = None) -> None:
        super().__init__(base, cols, index)
        self._geometry = None
        if geometry is not None:
            self.set_geometry(geometry)

    @classmethod
    def from_frame(cls, frame: Frame, geometry: str | None = None) -> GeoFrame:
        out = cls(frame.base, frame.cols, None, geometry)
        out._index, out.order = frame._index, frame.order
        return out

    def set_geometry(self, column: str) -> None:
        if not isinstance(column, str):
            raise TypeError("a column's name is needed")
        if column not in self.cols:
            raise KeyError(column)
        if "parts" not in getattr(self.df.schema[column].dataType, "names", []):
            raise TypeError(f"{column} holds no geometries")
        self._geometry = column

    @property
    def geometry(self) -> GeoSeries:
        if self._geometry is None:
            raise AttributeError("no geometry column is set")
        out = self._new(cols={self._geometry: self.cols[self._geometry]}, series=True)
        out.__class__ = GeoSeries
        return out

    def __getattr__(self, attr: str):
        if attr.startswith("_") or not hasattr(GeoSeries, attr):
            raise AttributeError(attr)
        return getattr(self.geometry, attr)

    def __getitem__(self, key):
        out = super().__getitem__(key)
        if isinstance(key, str) and key == self._geometry:
            out.__class__ = GeoSeries
        elif not isinstance(key, str) and self._geometry in out.cols:
            return GeoFrame.from_frame(out, self._geometry)
        return out

    def __delitem__(self, key: str) -> None:
        super().__delitem__(key)
        if key == self._geometry:
            self._geometry = None

    def _sides(self, other: GeoFrame) -> tuple[DataFrame, DataFrame]:
        if not isinstance(other, GeoFrame):
            raise TypeError("the other side must be a geo frame")
        if self._index is None or other._index is None:
            raise FrameError("both geo frames need an index")
        side = lambda f, k: f.df.select(name(f._index).alias(f"INDEXERIDA{k}"), name(f._geometry).alias(f"g{k}"))
        return side(self, 1), side(other, 2)

    def _pairs(self, other: GeoFrame, of, each=None) -> GeoFrame | Frame:
        """Every pair of rows, as the operation is defined: INDEXERIDA1, INDEXERIDA2, RESULT. Use matching() for predicates on many rows.

        each: what `of` needs of a geometry, found before the rows meet.
        """
        a, b = self._sides(other)
        if each:
            a, b = a.withColumn("g1", each(F.col("g1"))), b.withColumn("g2", each(F.col("g2")))
        return Frame(a.crossJoin(b).select("INDEXERIDA1", "INDEXERIDA2", of(F.col("g1"), F.col("g2")).alias("RESULT")))

    def matching(self, other: GeoFrame, predicate: str, cell: float | None = None) -> Frame:
        """The pairs for which a predicate (not disjoint) holds: rows meet where their boxes share a square of a grid with side `cell`.

        Without a side, it is half the mean extent of the rows whose boxes are larger.
        """
        if predicate not in PREDICATES or predicate == "disjoint":
            raise ValueError(f"not a predicate of meeting geometries: {predicate}")
        a, b = self._sides(other)
        cell = cell or max(_extent(a, "g1"), _extent(b, "g2")) / 2 or 1.0
        kinds = _kinds(a, "g1"), _kinds(b, "g2")
        at_place, point = _place_test(predicate, *kinds)
        area = 3 - point
        # Without other areas than rectangles along the axes, pairs are told by comparisons alone, which Spark compiles with the join.
        boxes = bool(point) and (b if point == 1 else a).agg(F.bool_and(G.is_box(F.col(f"g{area}")))).first()[0] is not False

        def gridded(d: DataFrame, g: str, k: int) -> DataFrame:
            ends = {f"{axis}{end}{k}": G.extreme(F.col(g), axis, end == "b") for axis in "xy" for end in "ab"}
            at = lambda c: F.floor(F.col(f"{c}{k}") / cell)
            box = d.where(G.is_empty(F.col(g)) == 0).withColumns(ends)
            if point == k or boxes:  # known by its ends
                box = box.drop(g)
            box = box.withColumn("x", F.explode(F.sequence(at("xa"), at("xb"))))
            return box.withColumn("y", F.explode(F.sequence(at("ya"), at("yb"))))

        # Never by broadcast: Spark takes the size of a side before its rows are laid on the grid.
        met = gridded(a, "g1", 1).hint("merge").join(gridded(b, "g2", 2), ["x", "y"])
        overlap = (F.col("xa1") <= F.col("xb2")) & (F.col("xa2") <= F.col("xb1")) & (F.col("ya1") <= F.col("yb2")) & (F.col("ya2") <= F.col("yb1"))
        if point:  # a point is in one square only
            x, y, ends = F.col(f"xa{point}"), F.col(f"ya{point}"), [F.col(f"{c}{area}") for c in ("xa", "xb", "ya", "yb")]
            at = G.place_in_box(x, y, ends) if boxes else G.place(x, y, F.col(f"g{area}"))
            return Frame(met.where(overlap & at_place(at)).select("INDEXERIDA1", "INDEXERIDA2"))
        # A pair that shares many squares is taken in the first of them.
        first = (F.col("x") == F.floor(F.greatest("xa1", "xa2") / cell)) & (F.col("y") == F.floor(F.greatest("ya1", "ya2") / cell))
        met = met.where(overlap & first)
        holds = _predicate(predicate, *kinds)
        return Frame(met.where(holds(F.col("g1"), F.col("g2")) == 1).select("INDEXERIDA1", "INDEXERIDA2"))

    def distance(self, other: GeoFrame, unit: str | None = None) -> Frame:
        m = G.check_unit(unit)

        def far(a, b):
            pq = O.nearest(a, b)
            if pq is None:
                return None
            (p, q) = pq
            flat = ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5
            return flat if m is None else (G.earth_distance(*p, *q) if a[1] in G.GEOGRAPHIC else flat) / m

        a, b = self._sides(other)
        if _kinds(a, "g1") | _kinds(b, "g2") <= {"POINT"}:
            return self._pairs(other, lambda p, q: G.distance_of(p, q, unit), G.spot)

        def both(a: Column, b: Column) -> Column:
            # A Python function is run for the rows of every branch: pairs of points go to it as nulls.
            points = (a["gtype"] == "POINT") & (b["gtype"] == "POINT")
            return F.when(points, G.point_distance(a, b, unit)).otherwise(_udf(far, "double")(F.when(~points, a), b))

        return self._pairs(other, both)

    def mbr_intersects(self, other: GeoFrame) -> Frame:
        return self._pairs(other, lambda p, q: G.boxes_meet(p, q).cast("int"), G.ends)


def _extent(d: DataFrame, g: str) -> float:
    """The mean of the larger sides of the boxes."""
    side = lambda axis: G.extreme(F.col(g), axis, True) - G.extreme(F.col(g), axis, False)
    return d.agg(F.avg(F.greatest(side("x"), side("y")))).first()[0] or 0.0


def _kinds(d: DataFrame, g: str) -> set[str]:
    """The geometry types of a column; an empty geometry counts as a type of its own."""
    kind = F.when(G.is_empty(F.col(g)) == 1, F.lit("EMPTY")).otherwise(F.col(g)["gtype"])
    return {r[0] for r in d.where(F.col(g).isNotNull()).select(kind).distinct().collect()}  # a few types


#: What the place of a point in an area (1 inside, 0 on the boundary, -1 outside) says, for the point as first operand.
_OF_PLACE = {"within": lambda at: at == 1, "intersects": lambda at: at >= 0, "touches": lambda at: at == 0, "disjoint": lambda at: at == -1}
_CONVERSE = {"within": "contains", "contains": "within"}


def _place_test(which: str, kinds1: set[str], kinds2: set[str]):
    """Of points against areas: the test of a point's place, and which side holds the points (1 or 2); else the side is 0."""
    side = 1 if kinds1 <= {"POINT"} and kinds2 <= {*AREAS} else 2 if kinds2 <= {"POINT"} and kinds1 <= {*AREAS} else 0
    return _OF_PLACE.get(_CONVERSE.get(which, which) if side == 2 else which, lambda at: F.lit(False)), side


def _predicate(which: str, kinds1: set[str], kinds2: set[str]):
    """Points against areas natively; of the rest, pairs whose boxes meet in Python."""
    test, point = _place_test(which, kinds1, kinds2)
    if point:
        return lambda a, b: F.when(a.isNotNull() & b.isNotNull(), test(G.locate(b, a) if point == 2 else G.locate(a, b))).cast("int")

    def of(a: Column, b: Column) -> Column:
        full = _udf(partial(O.predicate, which), "int")(a, b)
        if which == "disjoint":
            return F.when(G.mbr_intersects(a, b) == 0, 1).otherwise(full)
        return F.when(G.mbr_intersects(a, b) == 0, 0).otherwise(full)

    return of


def _holds(self: GeoFrame, other: GeoFrame, which: str) -> Frame:
    a, b = self._sides(other)
    return self._pairs(other, _predicate(which, _kinds(a, "g1"), _kinds(b, "g2")))


for _p in PREDICATES:
    setattr(GeoFrame, _p, lambda self, other, p=_p: _holds(self, other, p))
for _o in ("intersection", "union", "difference"):
    setattr(GeoFrame, _o, lambda self, other, o=_o: self._pairs(other, _udf(partial(O.combine, o))))
