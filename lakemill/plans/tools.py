"""Small helpers: settings, timing, and frames made larger or smaller for benchmarks."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

from pyspark.sql import functions as F

from ..operators.stats import name
from .frame import Frame

log = logging.getLogger("lakemill")
_verbose = False


def set_verbose(on: bool) -> None:
    """Whether timed functions say how long they took."""
    global _verbose
    if not isinstance(on, bool):
        raise ValueError("a boolean is needed")
    _verbose = on


def set_autocommit(on: bool) -> None:
    """Accepted and without effect: a catalog has no transactions."""
    if not isinstance(on, bool):
        raise ValueError("a boolean is needed")


def timed(function: Callable) -> Callable:
    """Say how many seconds a call took, if set_verbose(True)."""

    @wraps(function)
    def wrapper(*args, **kwargs):
        start = time.perf_counter()
        out = function(*args, **kwargs)
        if _verbose:
            print(f"Execution time: {time.perf_counter() - start} seconds.")
        return out

    return wrapper


def silent(function: Callable) -> Callable:
    """Call with set_verbose(False)."""

    @wraps(function)
    def wrapper(*args, **kwargs):
        was = _verbose
        set_verbose(False)
        try:
            return function(*args, **kwargs)
        finally:
            set_verbose(was)

    return wrapper


def chunklist(items: Sequence, n: int) -> Iterator[Sequence]:
    """Parts of n items, the last with the rest."""
    for a in range(0, len(items), n):
        yield items[a : a + n]


def to_nk(frame: Frame, thousands: int, seed: int = 0) -> Frame:
    """A frame of so many thousand rows: a random sample, or all rows and random ones again."""
    if isinstance(thousands, bool) or not isinstance(thousands, int) or thousands < 1:
        raise ValueError("a whole number from 1 on is needed")
    df, want, have = frame.df, thousands * 1000, len(frame)
    if not have:
        raise ValueError("the frame is empty")
    # Every row as often as it goes whole, and a random choice of them for the rest.
    whole, rest = divmod(want, have)
    again = df.withColumn("__again", F.explode(F.sequence(F.lit(1), F.lit(whole)))).drop("__again") if whole else df.limit(0)
    return Frame(again.unionAll(df.orderBy(F.rand(seed)).limit(rest)) if rest else again)


def extend_dataset(frame: Frame, n: int) -> Frame:
    """The columns, then n copies of them, the last numbered first: name_extended_n to name_extended_1."""
    df = frame.df
    return Frame(df.select(*map(name, df.columns), *[name(c).alias(f"{c}_extended_{k}") for k in range(n, 0, -1) for c in df.columns]))
