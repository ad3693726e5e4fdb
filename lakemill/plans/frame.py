"""Frame and Series: a Pandas-like, lazy view of a Spark DataFrame.

A frame is a base DataFrame and an ordered mapping of names to expressions over it. Selecting, computing and filtering only change
these; a plan runs when a result is asked for. Expressions of two frames can be combined when both stand on the same base.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..operators import features, stats
from ..operators.stats import name
from .shared import numbered, running


class LakemillError(Exception):
    """Base of this package's errors."""


class FrameError(LakemillError):
    pass


class Predicate:
    """A row condition over one base; &, | and ^ combine, ~ negates. Rows for which it is null are dropped."""

    def __init__(self, base: DataFrame, column: Column) -> None:
        self.base, self.column = base, column

    def _with(self, other: Predicate, of: Callable[[Column, Column], Column]) -> Predicate:
        if not isinstance(other, Predicate) or other.base is not self.base:
            raise ValueError("conditions of different tables can't be combined")
        return Predicate(self.base, of(self.column, other.column))

    def __and__(self, other: Predicate) -> Predicate:
        return self._with(other, lambda a, b: a & b)

    def __or__(self, other: Predicate) -> Predicate:
        return self._with(other, lambda a, b: a | b)

    def __xor__(self, other: Predicate) -> Predicate:
        return self._with(other, lambda a, b: (~a & b) | (a & ~b))

    def __invert__(self) -> Predicate:
        return Predicate(self.base, ~self.column)


def _floordiv(a: Column, b: Column) -> Column:
    return F.floor(F.try_divide(a, b))


def _mod(a: Column, b: Column) -> Column:
    """The sign is the dividend's; null for a divisor of 0."""
    return F.try_mod(a, b)


class Frame:
    """base: the plan it stands on; cols: output names and their expressions; index: a unique column or None; order: sort keys."""

    def __init__(self, base: DataFrame, cols: dict[str, Column] | None = None, index: str | None = None, order: Sequence[tuple[Column, bool]] = ()) -> None:
        self.base = base
        self.cols = {c: name(c) for c in base.columns} if cols is None else dict(cols)
        self.order = tuple(order)
        self._index = None
        if index is not None:
            self.index = index

    # Plans and results

    @property
    def df(self) -> DataFrame:
        return self.base.select(*[e.alias(c) for c, e in self.cols.items()])

    def spark(self) -> DataFrame:
        """The DataFrame, sorted if the frame is."""
        if not self.order:
            return self.df
        keyed = self.base.select(*[e.alias(c) for c, e in self.cols.items()], *[e.alias(f"__key{k}") for k, (e, _) in enumerate(self.order)])
        return keyed.orderBy(*self._keys(keyed)).drop(*[f"__key{k}" for k in range(len(self.order))])

    def _keys(self, df: DataFrame) -> list[Column]:
        return [F.col(f"__key{k}").asc_nulls_last() if up else F.col(f"__key{k}").desc_nulls_first() for k, (_, up) in enumerate(self.order)]

    def as_dataframe(self, limit: int | None = None):
        """A Pandas DataFrame. limit: refuse more rows than this."""
        df = self.spark()
        if limit is not None and len(df.limit(limit + 1).take(limit + 1)) > limit:
            raise FrameError(f"more than {limit} rows")
        return df.toPandas()

    def explain(self) -> None:
        self.spark().explain("formatted")

    def _new(self, **change) -> Frame:
        kind = Series if len(change.get("cols", self.cols)) == 1 and change.pop("series", False) else Frame
        out = kind.__new__(kind)
        out.base, out.cols, out.order, out._index = change.get("base", self.base), dict(change.get("cols", self.cols)), tuple(change.get("order", self.order)), change.get("index", self._index)
        return out

    # Attributes

    columns = property(lambda self: list(self.cols))
    dtypes = property(lambda self: dict(self.df.dtypes))
    shape = property(lambda self: (len(self), len(self.cols)))
    axes = property(lambda self: [self._index, self.columns])
    empty = property(lambda self: not self.base.take(1))

    @property
    def index(self) -> str | None:
        return self._index

    @index.setter
    def index(self, column: str | None) -> None:
        """Set the row identity. Its values must be unique and not null."""
        if column is not None:
            if column not in self.cols:
                raise KeyError(column)
            if self.df.groupBy(name(column)).agg(F.count("*").alias("__n")).where(F.col("__n") > 1).take(1):
                raise FrameError(f"{column} is not unique")
        self._index = column

    def __len__(self) -> int:
        return self.base.count()

    def __iter__(self):
        return iter(self.columns)

    # Selection

    def __getitem__(self, key):
        if isinstance(key, Predicate):
            if key.base is not self.base:
                raise ValueError("the condition is of another table")
            return self._new(base=self.base.where(key.column), series=isinstance(self, Series))
        if isinstance(key, slice):
            return self.rows(key)
        if isinstance(key, str):
            if key not in self.cols:
                raise KeyError(key)
            return self._new(cols={key: self.cols[key]}, series=True)
        if unknown := [c for c in key if c not in self.cols]:
            raise KeyError(unknown)
        return self._new(cols={c: self.cols[c] for c in key})

    def __setitem__(self, key: str | Sequence[str], value: Frame) -> None:
        """Add or replace columns by those of a frame on the same base."""
        names = [key] if isinstance(key, str) else list(key)
        if not isinstance(value, Frame):
            raise TypeError("only a frame or series can be assigned")
        if value.base is not self.base:
            raise ValueError("the values are of another table")
        if len(names) != len(value.cols):
            raise ValueError("as many names as columns are needed")
        self.cols.update(zip(names, value.cols.values(), strict=True))

    def __delitem__(self, key: str) -> None:
        if key not in self.cols:
            raise KeyError(key)
        del self.cols[key]
        if self._index == key:
            self._index = None

    def rows(self, key: slice) -> Frame:
        """Rows by place, or by index value if there is an index. Without a step both ends are included; with one the end is not."""
        start, step = key.start or 0, key.step
        if self._index is not None:
            at = name(self._index)
            cond = at >= start
            if key.stop is not None:
                cond &= at <= key.stop if step is None else at < key.stop
            if step is not None:
                cond &= (at - start) % step == 0
            d = self.spark() if not self.order else self.df
            return Frame(d.where(cond), order=[(name(self._index), True)])._new(index=self._index)
        at = self._numbered(key.stop if step is None else None if key.stop is None else key.stop - 1)
        cond = F.col("__at") >= start
        if key.stop is not None:
            cond &= F.col("__at") <= key.stop if step is None else F.col("__at") < key.stop
        if step is not None:
            cond &= (F.col("__at") - start) % step == 0
        return Frame(at.where(cond), {c: name(c) for c in self.cols}, order=[(F.col("__at"), True)])

    def _numbered(self, last: int | None = None) -> DataFrame:
        """The rows with their place (from 0) in the frame's order, or in that of all columns. last: the greatest place wanted."""
        keys = [e for e, _ in self.order] or [e for e in self.cols.values()]
        up = [u for _, u in self.order] or [True] * len(keys)
        d = self.base.select(*[e.alias(c) for c, e in self.cols.items()], *[e.alias(f"__key{k}") for k, e in enumerate(keys)])
        order = [F.col(f"__key{k}").asc_nulls_last() if u else F.col(f"__key{k}").desc_nulls_first() for k, u in enumerate(up)]
        if last is not None:
            # The first rows only: a top-k, whose places one window can give.
            d = d.orderBy(*order).limit(last + 1)
            from pyspark.sql import Window as W

            return d.withColumn("__at", F.row_number().over(W.orderBy(*order)) - 1)
        return numbered(d, order, "__at")

    @property
    def loc(self) -> Loc:
        return Loc(self)

    def head(self, nrow: int = 5, sort: bool = True) -> DataFrame:
        return self._end(nrow, sort, False)

    def tail(self, nrow: int = 5, sort: bool = True) -> DataFrame:
        """The last rows, in ascending order."""
        return self._end(nrow, sort, True)

    def _end(self, nrow: int, sort: bool, last: bool) -> DataFrame:
        """By the frame's order, else its index, else its first numeric column, else its first column; ties by all columns."""
        if nrow < 1:
            raise ValueError("nrow must be positive")
        df = self.df
        if not (self.order or sort or self._index):
            return df.limit(nrow)
        own = stats.numeric(df)
        keys = list(self.order) or [(self.cols[self._index or (own[0] if own else self.columns[0])], True)]
        keys += [(e, True) for e in self.cols.values() if not self.order]
        d = self.base.select(*[e.alias(c) for c, e in self.cols.items()], *[e.alias(f"__key{k}") for k, (e, _) in enumerate(keys)])
        by = lambda flip: [F.col(f"__key{k}").asc_nulls_last() if up != flip else F.col(f"__key{k}").desc_nulls_first() for k, (_, up) in enumerate(keys)]
        out = d.orderBy(*by(last)).limit(nrow)
        return out.orderBy(*by(False)).drop(*[f"__key{k}" for k in range(len(keys))])

    def sort(self, columns: str | Sequence[str] | None = None, axis: int = 0, ascending: bool = True, nulls: str | None = None) -> Frame:
        """axis 0: sort rows by columns, in one direction; no columns remove the order. axis 1: sort the columns' names.

        nulls: 'first' or 'last'; by default last ascending and first descending.
        """
        if nulls not in (None, "first", "last"):
            raise ValueError("nulls must be 'first' or 'last'")
        if axis == 1:
            return self._new(cols={c: self.cols[c] for c in sorted(self.cols, reverse=not ascending)})
        if axis != 0:
            raise ValueError("axis must be 0 or 1")
        names = self.columns if columns is None and isinstance(self, Series) else [columns] if isinstance(columns, str) else list(columns or [])
        if unknown := [c for c in names if c not in self.cols]:
            raise ValueError(f"unknown columns: {unknown}")
        ends = [] if nulls is None else [(self.cols[c].isNull(), nulls == "last") for c in names]
        keys = [(self.cols[c], ascending) for c in names]
        return self._new(order=[k for pair in zip(ends, keys, strict=True) for k in pair] if ends else keys)

    def add_column_id(self, column_id: str = "ID", order: Sequence[str] | None = None) -> Frame:
        """Number the rows from 0 in the order of the given columns (all by default), as first column and index."""
        if column_id in self.cols:
            raise ValueError(f"{column_id} exists")
        df = self.df
        d = numbered(df, [name(c).asc_nulls_last() for c in order or df.columns], column_id).select(name(column_id), *map(name, df.columns))
        return Frame(d)._new(index=column_id)

    def delete_na(self, columns: str | Sequence[str] | None = None, logic: str = "any") -> Frame:
        """Drop rows in which any, or all, of the columns are null."""
        if logic not in ("any", "all"):
            raise ValueError("logic must be 'any' or 'all'")
        names = [columns] if isinstance(columns, str) else list(columns or self.columns)
        if unknown := [c for c in names if c not in self.cols]:
            raise ValueError(f"unknown columns: {unknown}")
        has = [self.cols[c].isNotNull() for c in names]
        return self._new(base=self.base.where(reduce(operator.and_ if logic == "any" else operator.or_, has)), series=isinstance(self, Series))

    # Conditions: of all columns at once

    def _compare(self, of, value) -> Predicate:
        if isinstance(value, Frame):
            if value.base is not self.base or len(value.cols) != 1:
                raise ValueError("a condition compares with a literal or a series of the same table")
            value = next(iter(value.cols.values()))
        elif not isinstance(value, (str, int, float, bool)):
            raise TypeError("a condition compares with a text or number")
        return Predicate(self.base, reduce(operator.and_, [of(e, value) for e in self.cols.values()]))

    __lt__ = lambda self, v: self._compare(operator.lt, v)
    __le__ = lambda self, v: self._compare(operator.le, v)
    __gt__ = lambda self, v: self._compare(operator.gt, v)
    __ge__ = lambda self, v: self._compare(operator.ge, v)
    __eq__ = lambda self, v: self._compare(operator.eq, v)
    __ne__ = lambda self, v: self._compare(operator.ne, v)
    __hash__ = None

    # Arithmetic: column by column

    def _compute(self, other, of, flip: bool = False) -> Frame:
        if other is not None and isinstance(other, Frame):
            if other.base is not self.base:
                raise ValueError("the operands are of different tables")
            if len(other.cols) not in (1, len(self.cols)) and len(self.cols) != 1:
                raise ValueError("as many columns are needed on both sides, or one")
            right = list(other.cols.values()) * (len(self.cols) if len(other.cols) == 1 else 1)
            cols = dict(zip(other.cols, list(self.cols.values()) * len(other.cols), strict=True)) if len(self.cols) == 1 < len(other.cols) else self.cols
        elif isinstance(other, (int, float)) or other is None:
            right, cols = [F.lit(other)] * len(self.cols), self.cols
        else:
            raise TypeError("an operand must be a number, series or frame")
        for f in (self, other):
            if isinstance(f, Frame) and (odd := [c for c in f.cols if c not in stats.numeric(f.df)]):
                raise TypeError(f"not numeric: {odd}")
        out = {c: of(r, e) if flip else of(e, r) for (c, e), r in zip(cols.items(), right, strict=True)}
        return self._new(cols=out, series=isinstance(self, Series))

    __add__ = lambda self, o: self._compute(o, operator.add)
    __radd__ = lambda self, o: self._compute(o, operator.add, True)
    __sub__ = lambda self, o: self._compute(o, operator.sub)
    __rsub__ = lambda self, o: self._compute(o, operator.sub, True)
    __mul__ = lambda self, o: self._compute(o, operator.mul)
    __rmul__ = lambda self, o: self._compute(o, operator.mul, True)
    __truediv__ = lambda self, o: self._compute(o, F.try_divide)
    __rtruediv__ = lambda self, o: self._compute(o, F.try_divide, True)
    __floordiv__ = lambda self, o: self._compute(o, _floordiv)
    __rfloordiv__ = lambda self, o: self._compute(o, _floordiv, True)
    __mod__ = lambda self, o: self._compute(o, _mod)
    __rmod__ = lambda self, o: self._compute(o, _mod, True)
    __pow__ = lambda self, o: self._compute(o, F.pow)
    __rpow__ = lambda self, o: self._compute(o, F.pow, True)
    __neg__ = lambda self: self._compute(None, lambda e, _: -e)
    __pos__ = lambda self: self

    # Statistics: DataFrames; a series' are scalars

    def _stat(self, which: str):
        out = stats.stat(self.df, which)
        return out.first()[0] if isinstance(self, Series) else out

    count = lambda self: self._stat("count")
    count_distinct = lambda self: self._stat("count_distinct")
    levels = lambda self: self._stat("levels")
    min = lambda self: self._stat("min")
    max = lambda self: self._stat("max")
    sum = lambda self: self._stat("sum")
    mean = lambda self: self._stat("mean")
    std = lambda self: self._stat("std")
    var = lambda self: self._stat("var")
    nulls = lambda self: self._stat("nulls")
    mad = lambda self: stats.mad(self.df)
    cov = lambda self: stats.cov(self.df)
    corr = lambda self, features=None: stats.corr(self.df, features)
    median = lambda self: self.quantile(0.5)
    mode = lambda self: stats.mode(self.df)

    def quantile(self, q: float | Sequence[float] = 0.5, interpolation: str = "midpoint"):
        out = stats.percentiles(self.df, [q] if not isinstance(q, (list, tuple)) else q, None, interpolation)
        return out.first()["value"] if isinstance(self, Series) and not isinstance(q, (list, tuple)) else out

    def describe(self, percentiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
        return stats.describe(self.df, percentiles)

    def describe_text(self) -> DataFrame:
        return stats.describe_text(self.df)

    def groupby(self, by: str | Sequence[str]) -> Grouped:
        return Grouped(self, [by] if isinstance(by, str) else list(by))

    def _running(self, kind: str, value: Callable[[Column], Column] = lambda e: e) -> Frame:
        """The frame's numeric columns replaced by running aggregates in the frame's order, else its index's, else that of all columns."""
        own = stats.numeric(self.df)
        if not own:
            raise TypeError("no numeric column")
        keys = list(self.order) or [(e, True) for c, e in self.cols.items() if self._index in (None, c)]
        d = self.base.select(*[e.alias(c) for c, e in self.cols.items()], *[e.alias(f"__key{k}") for k, (e, _) in enumerate(keys)])
        order = [F.col(f"__key{k}").asc_nulls_last() if up else F.col(f"__key{k}").desc_nulls_first() for k, (_, up) in enumerate(keys)]
        own = [c for c in own if c != self._index]
        done = running(d, order, {f"__run{k}": (kind, value(name(c))) for k, c in enumerate(own)})
        cols = {c: F.col(f"__run{own.index(c)}") if c in own else name(c) for c in self.cols}
        return self._new(base=done, cols=cols, order=[(F.col(f"__key{k}"), up) for k, (_, up) in enumerate(keys)], series=isinstance(self, Series))

    cumsum = lambda self: self._running("sum")
    cummax = lambda self: self._running("max")
    cummin = lambda self: self._running("min")

    def cumprod(self) -> Frame:
        """Products as doubles."""
        return self._running("prod", lambda e: e.cast("double"))

    def cummean(self) -> Frame:
        """The mean of the values so far."""
        return self._running("mean", lambda e: e.cast("double"))

    def info(self) -> DataFrame:
        """column, type, count of values that are not null."""
        d = self.df
        one = stats.stat(d, "count")
        return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), name(c).alias("count")) for c, t in d.dtypes])).alias("s")).select("s.*")

    # The table that a frame of a catalog stands on

    def _table(self):
        if getattr(self, "table", None) is None:
            raise FrameError("the frame is not one of a catalog's tables or views")
        return self.database, self.table

    def exists(self) -> bool:
        database, table = self._table()
        return database.exists_table_or_view(table)

    def is_view(self) -> bool:
        database, table = self._table()
        return database.is_view(table)

    def is_table(self) -> bool:
        database, table = self._table()
        return database.is_table(table)

    def get_primary_key(self) -> str | None:
        database, table = self._table()
        return database.get_primary_key(table)

    def unique(self, column: str | None = None) -> DataFrame:
        return stats.unique(self.df, column or self.columns[0])

    def count_groupby(self, columns: Sequence[str] | None = None, having: float | None = None) -> DataFrame:
        return stats.count_groupby(self.df, [columns] if isinstance(columns, str) else columns or self.columns, having)

    def mean_groupby(self, groupby: str, features: Sequence[str] | None = None) -> DataFrame:
        return stats.mean_groupby(self.df, groupby, features)

    def mean_freq_of_instance(self, columns: Sequence[str] | None = None) -> DataFrame:
        return stats.mean_freq(self.df, columns)

    def within_class_var(self, target: str, features: Sequence[str] | None = None) -> DataFrame:
        return stats.within_class(self.df, target, features)

    def within_class_std(self, target: str, features: Sequence[str] | None = None) -> DataFrame:
        return stats.within_class(self.df, target, features, root=True)

    def pivot_table(self, values: str | Sequence[str] | None = None, columns: str | Sequence[str] | None = None, max_entries: int | None = 1000, sort: str | None = None, factor_threshold: int = 20, aggfunc: str = "count") -> DataFrame:
        """Default columns: the categorical ones of level_table()."""
        as_list = lambda x: [x] if isinstance(x, str) else list(x)
        df = self.df
        if columns is None:
            columns = [r["column"] for r in stats.level_table(df, factor_threshold).where("valtype = 'CATEGORICAL'").collect()]
            if not columns:
                raise ValueError("no categorical column")
        out = stats.pivot_table(df, None if values is None else as_list(values), as_list(columns), aggfunc, max_entries)
        return out.orderBy("value", *map(name, as_list(columns))) if sort in ("factor", "factors") else out

    # With other frames

    def merge(self, other: Frame, on: str | Sequence[str], how: str = "inner") -> Frame:
        return Frame(self.df.join(other.df, [on] if isinstance(on, str) else list(on), how))

    join = merge

    def concat(self, other: Frame) -> Frame:
        if self.columns != other.columns:
            raise ValueError("both frames need the same columns in the same order")
        return Frame(self.df.unionAll(other.df))

    def rank(self, column: str | None = None) -> Frame:
        """The frame with a column rank: the place of the first of equal values, nulls last."""
        c = column or self.columns[0]
        d = self.df
        counts = d.groupBy(name(c).alias("__v")).agg(F.count("*").alias("__c"))
        placed = numbered(counts, [F.col("__v").asc_nulls_last()], "__p")
        # Ranks of values: prefix sums of their counts, range by range.
        from .shared import prefix_sums

        ranks = prefix_sums(placed, "__p", "__c", "rank").select("__v", (F.col("rank") + 1).alias("rank"))
        few = isinstance(d.schema[c].dataType, NumericType) and placed.count() <= features.BROADCAST_VALUES
        return Frame(d.join(F.broadcast(ranks) if few else ranks, name(c).eqNullSafe(F.col("__v"))).drop("__v"))

    def corrwith(self, other: str) -> DataFrame:
        return features.pearson(self.df, other)


class Grouped:
    """Groups of a frame: agg() with functions by column, or one function of all numeric columns."""

    def __init__(self, frame: Frame, by: list[str]) -> None:
        self.frame, self.by = frame, by

    def agg(self, of: dict[str, str | Sequence[str]]) -> DataFrame:
        return stats.grouped(self.frame.df, self.by, of)

    def size(self) -> DataFrame:
        return stats.count_groupby(self.frame.df, self.by)

    def _all(self, function: str) -> DataFrame:
        return self.agg({c: function for c in stats.numeric(self.frame.df) if c not in self.by})


for _f in stats.AGGREGATES:
    setattr(Grouped, _f, lambda self, f=_f: self._all(f))


class Series(Frame):
    """A frame of one column. Its reductions are scalars."""

    name = property(lambda self: self.columns[0])


class Loc:
    """Rows by index value (by place without an index) and columns by name."""

    def __init__(self, frame: Frame) -> None:
        self.frame = frame

    def __getitem__(self, key):
        rows, cols = key if isinstance(key, tuple) else (key, None)
        f = self.frame
        if isinstance(rows, slice):
            out = f.rows(rows)
        elif isinstance(rows, Predicate):
            out = f[rows]
        else:
            wanted = list(rows) if isinstance(rows, (list, tuple)) else [rows]
            if f._index is not None:
                out = Frame(f.df.where(name(f._index).isin(*wanted)))._new(index=f._index)
                if cols is not None and f._index not in ([cols] if isinstance(cols, str) else cols):
                    out._index = None
            else:
                at = f._numbered(max(wanted))
                out = Frame(at.where(F.col("__at").isin(*wanted)), {c: name(c) for c in f.cols})
        return out if cols is None else out[cols]
