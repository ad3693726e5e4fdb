"""Planar geometry algorithms on tuples (gtype, srid, has_z, has_m, parts), for what native expressions can't say.

Areas are handled by vertical slabs: between neighbouring vertex and crossing abscissas no two edges cross, so a slab is a stack of
trapezoids, each wholly inside or outside of either operand.
"""

from __future__ import annotations

import math
from itertools import pairwise

EPS = 1e-9


def rings(g) -> list[list[tuple[float, float]]]:
    return [[(p[0], p[1]) for p in r] for part in g[4] for r in part]


def segments(g) -> list[tuple[tuple[float, float], tuple[float, float]]]:
    return [s for r in rings(g) for s in pairwise(r) if s[0] != s[1]]


def dim(g) -> int:
    return -1 if not any(rings(g)) else 0 if g[0].endswith("POINT") else 1 if g[0].endswith("LINESTRING") else 2


def _on(p, s) -> bool:
    (x, y), ((x1, y1), (x2, y2)) = p, s
    n = math.hypot(x2 - x1, y2 - y1)
    if abs((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) > EPS * max(n, 1):
        return False
    t = ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (n * n)
    return -EPS <= t <= 1 + EPS


def inside(p, rs) -> bool:
    """Even-odd rule over all rings."""
    x, y, odd = *p, False
    for r in rs:
        for (x1, y1), (x2, y2) in pairwise(r):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def locate(g, p) -> str:
    """Where a point is: i(nterior), b(oundary) or e(xterior)."""
    d = dim(g)
    near = lambda a, b: abs(a[0] - b[0]) <= EPS and abs(a[1] - b[1]) <= EPS
    if d == 0:
        return "i" if any(near(q, p) for r in rings(g) for q in r) else "e"
    on = any(_on(p, s) for s in segments(g))
    if d == 1:
        ends = sum(near(q, p) for r in rings(g) if not near(r[0], r[-1]) for q in (r[0], r[-1]))
        return "b" if ends % 2 else "i" if on else "e"
    if on:
        return "b"
    return "i" if d == 2 and inside(p, rings(g)) else "e"


def crossings(s, t) -> list[float]:
    """Places on s, from 0 to 1, where t meets it."""
    (x1, y1), (x2, y2) = s
    (x3, y3), (x4, y4) = t
    dx, dy, ex, ey = x2 - x1, y2 - y1, x4 - x3, y4 - y3
    den = dx * ey - dy * ex
    if abs(den) > 1e-15 * max(1, math.hypot(dx, dy) * math.hypot(ex, ey)):
        u = ((x3 - x1) * ey - (y3 - y1) * ex) / den
        v = ((x3 - x1) * dy - (y3 - y1) * dx) / den
        return [min(max(u, 0), 1)] if -EPS <= u <= 1 + EPS and -EPS <= v <= 1 + EPS else []
    n = dx * dx + dy * dy
    out = []
    for q in (t[0], t[1]):
        if _on(q, s):
            out.append(min(max(((q[0] - x1) * dx + (q[1] - y1) * dy) / n, 0), 1))
    return out


def pieces(g, other):
    """The segments of g, cut where other's meet them."""
    others = segments(other) if dim(other) > 0 else []
    pts = [q for r in rings(other) for q in r] if dim(other) == 0 else []
    for s in segments(g):
        (x1, y1), (x2, y2) = s
        at = {0.0, 1.0}
        for t in others:
            at.update(crossings(s, t))
        for q in pts:
            if _on(q, s):
                n = (x2 - x1) ** 2 + (y2 - y1) ** 2
                at.add(min(max(((q[0] - x1) * (x2 - x1) + (q[1] - y1) * (y2 - y1)) / n, 0), 1))
        cut = [(x1 + (x2 - x1) * u, y1 + (y2 - y1) * u) for u in sorted(at)]
        yield from (p for p in pairwise(cut) if math.dist(*p) > EPS)


def slabs(gs):
    """Trapezoids (x1, x2, lower left y, upper left y, lower right y, upper right y, flags): flags say inside which of gs."""
    edges = []
    for k, g in enumerate(gs):
        if dim(g) == 2:
            edges += [(k, min(s), max(s)) for s in segments(g)]
    xs = {p[0] for _, a, b in edges for p in (a, b)}
    for i, (_, a, b) in enumerate(edges):
        for _, c, d in edges[i + 1 :]:
            if max(a[0], c[0]) <= min(b[0], d[0]):
                xs.update(a[0] + (b[0] - a[0]) * u for u in crossings((a, b), (c, d)))
    order = sorted(xs)
    for x1, x2 in pairwise(order):
        if x2 - x1 <= EPS:
            continue
        mid, here = (x1 + x2) / 2, []
        for k, a, b in edges:
            if a[0] <= mid <= b[0] and b[0] > a[0]:
                y = lambda x, a=a, b=b: a[1] + (b[1] - a[1]) * (x - a[0]) / (b[0] - a[0])
                here.append((y(mid), k, y(x1), y(x2)))
        here.sort()
        flags = [False] * len(gs)
        for lo, hi in pairwise(here):
            flags[lo[1]] = not flags[lo[1]]
            if hi[0] - lo[0] > EPS:
                yield (x1, x2, lo[2], hi[2], lo[3], hi[3], tuple(flags))


def relate(a, b) -> tuple[dict[str, bool], bool]:
    """Which of interior, boundary and exterior of a meet those of b ('ib': a's interior, b's boundary), and whether two lines share a piece."""
    m: dict[str, bool] = {}
    shared = False
    for g, other, flip in ((a, b, False), (b, a, True)):
        put = lambda mine, theirs, flip=flip: m.__setitem__(theirs + mine if flip else mine + theirs, True)
        if dim(g) == 0:
            for r in rings(g):
                for p in r:
                    put("i", locate(other, p))
            continue
        kind = "b" if dim(g) == 2 else "i"
        for p, q in pieces(g, other):
            mid = ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)
            where = locate(other, mid)
            put(kind, where)
            shared |= where == "i" and dim(other) == 1
            for v in (p, q):
                put("b" if dim(g) == 2 else locate(g, v), locate(other, v))
    if 2 in (dim(a), dim(b)):
        for *_, flags in slabs([a, b]):
            if dim(a) == dim(b) == 2:
                m["i" if flags[0] else "e", "i" if flags[1] else "e"] = True
        for key in [k for k in m if isinstance(k, tuple)]:
            m["".join(key)] = m.pop(key)
        if dim(a) == 2 > dim(b):
            m["ie"] = True
        if dim(b) == 2 > dim(a):
            m["ei"] = True
    return m, shared


def predicate(name: str, a, b) -> int:
    """1 or 0; an empty geometry is disjoint from all."""
    if dim(a) < 0 or dim(b) < 0:
        return int(name == "disjoint" or name == "equals" and dim(a) == dim(b))
    m, shared = relate(a, b)
    t = lambda k: m.get(k, False)
    meets = t("ii") or t("ib") or t("bi") or t("bb")
    da, db = dim(a), dim(b)
    out = {
        "intersects": meets,
        "disjoint": not meets,
        "equals": meets and not (t("ie") or t("be") or t("ei") or t("eb")),
        "within": t("ii") and not t("ie") and not t("be"),
        "contains": t("ii") and not t("ei") and not t("eb"),
        "touches": meets and not t("ii"),
        "overlaps": da == db and t("ii") and t("ie") and t("ei") and (da != 1 or shared),
        "crosses": t("ii") and (t("ie") if da < db else t("ei") if da > db else da == 1 and not shared),
    }[name]
    return int(bool(out))


def _areal(srid, traps) -> tuple:
    parts = []
    for x1, x2, l1, h1, l2, h2 in traps:
        ring = [(x1, l1), (x2, l2), (x2, h2), (x1, h1)]
        ring = [p for k, p in enumerate(ring) if math.dist(p, ring[k - 1]) > EPS]
        if len(ring) >= 3:
            parts.append([[(*p, None, None) for p in (*ring, ring[0])]])
    return ("POLYGON" if len(parts) == 1 else "MULTIPOLYGON", srid, False, False, parts)


def combine(op: str, a, b):
    """intersection, union or difference. Areas come out as polygons of slabs; lines and points keep their kind.

    None where the result has no one kind (a line united with an area) or nothing is left, except that an empty intersection is an empty point.
    """
    da, db = dim(a), dim(b)
    empty = ("POINT", a[1], False, False, [])
    if da < 0 or db < 0:
        return empty if op == "intersection" else (a if da >= 0 else b if op == "union" else None)
    if da == db == 2:
        want = {"intersection": lambda f: f[0] and f[1], "union": lambda f: f[0] or f[1], "difference": lambda f: f[0] and not f[1]}[op]
        out = _areal(a[1], _merged([t[:6] for t in slabs([a, b]) if want(t[6])]))
        return out if out[4] else empty if op == "intersection" else None
    if op == "union":
        if da != db:
            return None
        own = _kept(b, a, False)
        return _of(da, a[1], [*a[4], *own])
    if op == "intersection" and da > db:
        a, b, da, db = b, a, db, da
    if op == "difference" and da > db:
        return a
    parts = _kept(a, b, op == "intersection")
    return _of(da, a[1], parts) if parts else empty if op == "intersection" else None


def _kept(a, b, meeting: bool) -> list:
    """The points or pieces of lines of a that meet b, or that don't."""
    if dim(a) == 0:
        return [[[(*p, None, None)]] for r in rings(a) for p in r if (locate(b, p) != "e") == meeting]
    out = []
    for p, q in pieces(a, b):
        mid = ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)
        if (locate(b, mid) != "e") == meeting:
            if out and out[-1][0][-1][:2] == p:
                out[-1][0].append((*q, None, None))
            else:
                out.append([[(*p, None, None), (*q, None, None)]])
    return out


def _of(d: int, srid: int, parts: list) -> tuple:
    kind = ("POINT", "LINESTRING")[d]
    return (kind if len(parts) == 1 else f"MULTI{kind}", srid, False, False, parts)


def _merged(traps: list) -> list:
    """Join trapezoids stacked on one another, then neighbours with the same sides."""
    out: list = []
    for t in sorted(traps):
        if out and out[-1][:2] == t[:2] and abs(out[-1][3] - t[2]) <= EPS and abs(out[-1][5] - t[4]) <= EPS:
            out[-1] = (*out[-1][:3], t[3], out[-1][4], t[5])
        else:
            out.append(t)
    done: list = []
    for t in out:
        for k, p in enumerate(done):
            slope = lambda u, lo: (u[4] - u[2] if lo else u[5] - u[3]) / (u[1] - u[0])
            if abs(p[1] - t[0]) <= EPS and abs(p[4] - t[2]) <= EPS and abs(p[5] - t[3]) <= EPS and abs(slope(p, True) - slope(t, True)) <= EPS and abs(slope(p, False) - slope(t, False)) <= EPS:
                done[k] = (p[0], t[1], p[2], p[3], t[4], t[5])
                break
        else:
            done.append(t)
    return done


def hull(g):
    pts = sorted({p for r in rings(g) for p in r})
    if len(pts) < 3:
        return ("POINT", g[1], False, False, [[[(*p, None, None)]] for p in pts]) if len(pts) < 2 else ("LINESTRING", g[1], False, False, [[[(*p, None, None) for p in pts]]])
    turn = lambda o, p, q: (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
    half = []
    for seq in (pts, pts[::-1]):
        chain: list = []
        for p in seq:
            while len(chain) > 1 and turn(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        half += chain[:-1]
    if len(half) < 3:
        return ("LINESTRING", g[1], False, False, [[[(*p, None, None) for p in (pts[0], pts[-1])]]])
    return ("POLYGON", g[1], False, False, [[[(*p, None, None) for p in (*half, half[0])]]])


def generalize(g, threshold: float):
    """Douglas and Peucker's simplification of every ring; rings keep at least a triangle."""

    def thin(r):
        keep, stack = {0, len(r) - 1}, [(0, len(r) - 1)]
        while stack:
            a, b = stack.pop()
            far, at = -1.0, None
            for k in range(a + 1, b):
                d = _distance(r[k][:2], (r[a][:2], r[b][:2]))
                if d > far:
                    far, at = d, k
            if at is not None and far > threshold:
                keep.add(at)
                stack += [(a, at), (at, b)]
        out = [r[k] for k in sorted(keep)]
        return r if g[0].endswith("POLYGON") and len(out) < 4 else out

    return (*g[:4], [[thin(r) for r in part] for part in g[4]])


def _distance(p, s) -> float:
    (x1, y1), (x2, y2) = s
    n = (x2 - x1) ** 2 + (y2 - y1) ** 2
    t = 0 if n == 0 else min(max(((p[0] - x1) * (x2 - x1) + (p[1] - y1) * (y2 - y1)) / n, 0), 1)
    return math.dist(p, (x1 + t * (x2 - x1), y1 + t * (y2 - y1)))


def nearest(a, b):
    """The two nearest points of a and b, or None."""
    if dim(a) < 0 or dim(b) < 0:
        return None
    best = None
    for g, h, flip in ((a, b, False), (b, a, True)):
        lines = segments(h) or [(p, p) for r in rings(h) for p in r]
        for r in rings(g):
            for p in r:
                if dim(h) == 2 and locate(h, p) != "e":
                    return (p, p)
                for s in lines:
                    (x1, y1), (x2, y2) = s
                    n = (x2 - x1) ** 2 + (y2 - y1) ** 2
                    t = 0 if n == 0 else min(max(((p[0] - x1) * (x2 - x1) + (p[1] - y1) * (y2 - y1)) / n, 0), 1)
                    q = (x1 + t * (x2 - x1), y1 + t * (y2 - y1))
                    d = math.dist(p, q)
                    if best is None or d < best[0]:
                        best = (d, q, p) if flip else (d, p, q)
    if dim(a) > 0 and dim(b) > 0:
        for s in segments(a):
            for t in segments(b):
                if c := crossings(s, t):
                    (x1, y1), (x2, y2) = s
                    p = (x1 + c[0] * (x2 - x1), y1 + c[0] * (y2 - y1))
                    return (p, p)
    return best[1:]


def buffer(g, distance: float, arcs: int = 16):
    """All within `distance`, with round ends of 4*arcs sides. Negative distances shrink areas and leave nothing of lines and points."""
    if dim(g) < 0:
        return ("POINT", g[1], False, False, [])
    r = abs(distance)
    circle = [(math.cos(2 * math.pi * k / (4 * arcs)) * r, math.sin(2 * math.pi * k / (4 * arcs)) * r) for k in range(4 * arcs)]
    ends = segments(g) or [(p, p) for q in rings(g) for p in q]
    out = None
    for s in ends:
        pts = [[[(x + cx, y + cy, None, None)]] for x, y in {*s} for cx, cy in circle]
        capsule = hull(("MULTIPOINT", g[1], False, False, pts))
        out = capsule if out is None else combine("union", out, capsule)
    if distance < 0:
        return (combine("difference", g, out) or ("POINT", g[1], False, False, [])) if dim(g) == 2 else ("POINT", g[1], False, False, [])
    return combine("union", g, out) if dim(g) == 2 else out


def boundary(g):
    d = dim(g)
    if d <= 0:
        return ("POINT", g[1], False, False, [])
    if d == 1:
        count: dict = {}
        for part in g[4]:
            r = part[0]
            if r[0] != r[-1]:
                for p in (r[0], r[-1]):
                    count[p] = count.get(p, 0) + 1
        ends = [[[p]] for p, n in count.items() if n % 2]
        return ("POINT" if len(ends) < 2 else "MULTIPOINT", *g[1:4], ends)
    rs = [[r] for part in g[4] for r in part]
    return ("LINESTRING" if len(rs) == 1 else "MULTILINESTRING", *g[1:4], rs)


def is_simple(g) -> int:
    """No point twice, and no ring meets itself but at its ends."""
    if dim(g) <= 0:
        pts = [p for r in rings(g) for p in r]
        return int(len(pts) == len({*pts}))
    for r in rings(g):
        ss = [s for s in pairwise(r) if s[0] != s[1]]
        for i, s in enumerate(ss):
            for j in range(i + 1, len(ss)):
                hit = crossings(s, ss[j])
                if not hit:
                    continue
                follow = j == i + 1 and all(u >= 1 - EPS for u in hit) and s[0] != ss[j][1]
                closing = i == 0 and j == len(ss) - 1 and r[0] == r[-1] and all(u <= EPS for u in hit)
                if not (follow or closing or (j == i + 1 == 1 and len(ss) == 2 and r[0] == r[-1])):
                    return 0
    return 1


def is_valid(g) -> int:
    """Polygon rings are closed, simple and have an area; linestrings have two points."""
    if dim(g) == 2:
        return int(all(len(r) >= 4 and r[0] == r[-1] and abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in pairwise(r))) > EPS for r in rings(g)) and bool(is_simple(g)))
    return int(dim(g) != 1 or all(len({*r}) > 1 for r in rings(g)))


def mid_point(g):
    """Half way along a line, with z and m interpolated."""
    r = [p for part in g[4] for q in part for p in q]
    if not r:
        return ("POINT", *g[1:4], [])
    lens = [math.dist(a[:2], b[:2]) for a, b in pairwise(r)]
    left = sum(lens) / 2
    for (a, b), n in zip(pairwise(r), lens, strict=True):
        if left <= n and n > 0:
            t = left / n
            return ("POINT", *g[1:4], [[[tuple(None if u is None or v is None else u + (v - u) * t for u, v in zip(a, b, strict=True))]]])
        left -= n
    return ("POINT", *g[1:4], [[[r[0]]]])
