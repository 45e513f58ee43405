"""Overlay of polygons with holes and parts: unions, intersections and differences as geometry.

A polygon is a list of rings, inside by the even-odd rule, so rings that cross themselves are regions too; a region is a list of polygons, which may
overlap. Coordinates are rounded to a grid of integers, on which all tests are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import cmp_to_key

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Polygon = list[np.ndarray]
#: Coordinates stay below this, so that products of two differences fit 64 bits.
MOST = 1_000_000_000
RINGS = "array<array<array<double>>>"


def grid_scale(*regions: Iterable[Polygon]) -> float:
    """The power of ten that brings the largest coordinate below MOST."""
    most = max((float(np.abs(r).max()) for region in regions for p in region for r in p if len(r)), default=1.0)
    return 10.0 ** int(np.floor(np.log10(MOST / max(most, 1e-9))))


def _edges(region: Iterable[Polygon], scale: float, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (x, y, x, y) on the grid and which polygon each belongs to, numbered from ``first``."""
    edges, owner = [np.zeros((0, 4), np.int64)], []
    for k, polygon in enumerate(region):
        for ring in polygon:
            p = np.rint(np.asarray(ring, np.float64).reshape(-1, 2) * scale).astype(np.int64)
            e = np.hstack([p, np.roll(p, -1, axis=0)])
            e = e[(e[:, :2] != e[:, 2:]).any(axis=1)]
            edges.append(e)
            owner += [first + k] * len(e)
    return np.concatenate(edges), np.array(owner, np.int64)


def _cross(o: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, 0] - o[:, 0]) * (b[:, 1] - o[:, 1]) - (a[:, 1] - o[:, 1]) * (b[:, 0] - o[:, 0])


def near_edges(edges: np.ndarray, at_once: int = 1_000_000) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    """Pairs of edges whose boxes meet, some at a time: by order of their left ends, then their heights."""
    low, high = np.minimum(edges[:, :2], edges[:, 2:]), np.maximum(edges[:, :2], edges[:, 2:])
    by = np.argsort(low[:, 0], kind="stable")
    until = np.searchsorted(low[by, 0], high[by, 0], side="right")
    count = until - np.arange(len(by)) - 1
    ends = np.cumsum(count)
    start = 0
    while start < len(by):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + at_once)))
        n = count[start:stop]
        i = np.repeat(np.arange(start, stop), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        i, j = by[i], by[j]
        meet = (low[i, 1] <= high[j, 1]) & (low[j, 1] <= high[i, 1])
        yield i[meet], j[meet]
        start = stop


def _splits(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edge, point) where edges cross, or where an end of one lies on another."""
    which, points = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]

    def note(edge: np.ndarray, point: np.ndarray) -> None:
        p, q = edges[edge, :2], edges[edge, 2:]
        new = (point != p).any(axis=1) & (point != q).any(axis=1)
        which.append(edge[new])
        points.append(point[new])

    for i, j in near_edges(edges):
        pi, qi, pj, qj = edges[i, :2], edges[i, 2:], edges[j, :2], edges[j, 2:]
        a, b, c, d = _cross(pi, qi, pj), _cross(pi, qi, qj), _cross(pj, qj, pi), _cross(pj, qj, qi)
        x = (np.sign(a) * np.sign(b) < 0) & (np.sign(c) * np.sign(d) < 0)
        t = c[x] / (c[x].astype(np.float64) - d[x])
        at = pi[x] + np.rint((qi[x] - pi[x]) * t[:, None]).astype(np.int64)
        note(i[x], at)
        note(j[x], at)
        for edge, p, q, point, side in ((i, pi, qi, pj, a), (i, pi, qi, qj, b), (j, pj, qj, pi, c), (j, pj, qj, qi, d)):
            on = (side == 0) & (np.minimum(p, q) <= point).all(axis=1) & (point <= np.maximum(p, q)).all(axis=1)
            note(edge[on], point[on])
    return np.concatenate(which), np.concatenate(points)


def noded(edges: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same edges cut wherever they meet, until they only share ends. A cut rounds to the grid and may bend an edge by half a step."""
    while True:
        which, points = _splits(edges)
        if not len(which):
            return edges, owner
        # Ends and cuts of the edges that are cut, in order along each.
        cut = np.unique(which)
        e = np.concatenate([which, cut, cut])
        p = np.concatenate([points, edges[cut, :2], edges[cut, 2:]])
        along = ((p - edges[e, :2]).astype(np.float64) * (edges[e, 2:] - edges[e, :2])).sum(axis=1)
        order = np.lexsort((p[:, 1], p[:, 0], along, e))
        e, p = e[order], p[order]
        link = (e[1:] == e[:-1]) & (p[1:] != p[:-1]).any(axis=1)
        whole = np.ones(len(edges), bool)
        whole[cut] = False
        edges = np.concatenate([edges[whole], np.hstack([p[:-1][link], p[1:][link]])])
        owner = np.concatenate([owner[whole], owner[e[:-1][link]]])


def labelled(edges: np.ndarray, owner: np.ndarray) -> list[tuple[tuple, tuple, frozenset, frozenset]]:
    """Edges (left end, right end, polygons below, polygons above), each once, by a sweep from left to right.

    The status holds the edges that the sweep meets, from below to above; an edge's lower side is its lower neighbour's upper side, and its own
    polygons (those to which it belongs an odd number of times) change in between.
    """
    whose: dict[tuple, frozenset] = {}
    for (a, b, c, d), k in zip(edges.tolist(), owner.tolist(), strict=True):
        e = ((a, b), (c, d)) if (a, b) < (c, d) else ((c, d), (a, b))
        whose[e] = whose.get(e, frozenset()) ^ {k}
    begins: dict[tuple, list[tuple]] = {}
    ending: dict[tuple, int] = {}
    for e, k in whose.items():
        if k:
            begins.setdefault(e[0], []).append(e)
            ending[e[1]] = ending.get(e[1], 0) + 1

    def steeper(e: tuple, f: tuple) -> int:
        return (f[1][0] - f[0][0]) * (e[1][1] - e[0][1]) - (f[1][1] - f[0][1]) * (e[1][0] - e[0][0])

    status: list[tuple[tuple, frozenset]] = []
    out = []
    for point in sorted(begins.keys() | ending.keys()):
        x, y = point
        low, high = 0, len(status)
        while low < high:
            mid = (low + high) // 2
            (a, b), (c, d) = status[mid][0]
            if (c - a) * (y - b) - (d - b) * (x - a) > 0:
                low = mid + 1
            else:
                high = mid
        del status[low : low + ending.get(point, 0)]
        below = status[low - 1][1] if low else frozenset()
        fresh = []
        for e in sorted(begins.get(point, ()), key=cmp_to_key(steeper)):
            above = below ^ whose[e]
            out.append((*e, below, above))
            fresh.append((e, above))
            below = above
        status[low:low] = fresh
    return out


def _rings(sides: list[tuple[tuple, tuple]]) -> list[np.ndarray]:
    """Directed edges with the region on their left as rings: at each point the next edge clockwise from where one came."""
    leaving: dict[tuple, list[tuple]] = {}
    for a, b in sides:
        leaving.setdefault(a, []).append(b)
    angle = lambda a, b: np.arctan2(b[1] - a[1], b[0] - a[0])
    out = []
    left = set(sides)
    for a, b in sides:
        if (a, b) not in left:
            continue
        ring, u, v = [a], a, b
        while (nxt := _turn(angle, u, v, leaving, left)) is not None and (v, nxt) != (a, b):
            ring.append(v)
            left.discard((v, nxt))
            u, v = v, nxt
        left.discard((a, b))
        out.append(np.array(ring))
    return out


def _turn(angle: Callable, u: tuple, v: tuple, leaving: dict, left: set) -> tuple | None:
    back = angle(v, u)
    some = [w for w in leaving[v] if (v, w) in left]
    return min(some, key=lambda w: (back - angle(v, w)) % (2 * np.pi) or 2 * np.pi, default=None)


def ring_area(ring: np.ndarray) -> float:
    """Signed area, positive if counter-clockwise; exact on integers."""
    if len(ring) < 3:
        return 0.0
    r = ring - ring[0]
    x, y = r[:, 0], r[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def _holds(ring: np.ndarray, x: float, y: float) -> bool:
    a, b = ring, np.roll(ring, -1, axis=0)
    up = (a[:, 1] > y) != (b[:, 1] > y)
    dy = np.where(up, b[:, 1] - a[:, 1], 1)
    return bool((up & (x < (b[:, 0] - a[:, 0]) * ((y - a[:, 1]) / dy) + a[:, 0])).sum() % 2)


def assembled(rings: list[np.ndarray]) -> list[Polygon]:
    """Rings as polygons: counter-clockwise ones are outer, each clockwise one is a hole of the least outer ring around it."""
    outer = sorted((r for r in rings if ring_area(r) > 0), key=ring_area)
    out = [[r] for r in outer]
    for r in rings:
        if ring_area(r) < 0:
            x, y = (r[0] + r[1]) / 2
            at = next((k for k, o in enumerate(outer) if ring_area(o) > -ring_area(r) and _holds(o, x, y)), None)
            if at is not None:
                out[at].append(r)
    return out


def is_convex(ring: np.ndarray) -> bool:
    """Whether a ring of the grid is convex, counter-clockwise and winds once; exact on integers."""
    d = np.roll(ring, -1, axis=0) - ring
    e = np.roll(d, -1, axis=0)
    if len(ring) < 3 or not (d != 0).any(axis=1).all() or (d[:, 0] * e[:, 1] < d[:, 1] * e[:, 0]).any():
        return False
    # Turns to the left only, none of them back: once around if the edges turn from upper to lower headings once.
    upper = (d[:, 1] > 0) | ((d[:, 1] == 0) & (d[:, 0] > 0))
    back = (d[:, 0] * e[:, 1] == d[:, 1] * e[:, 0]) & ((d * e).sum(axis=1) < 0)
    return not back.any() and int((upper & ~np.roll(upper, -1)).sum()) == 1


def _lone(region: list[Polygon], scale: float, shift: np.ndarray | None = None) -> tuple[dict[int, np.ndarray], list[int]]:
    """Polygons of one convex ring whose boxes meet no other's, as rings of the grid from their least point on, and the numbers of the others that cover something.
    ``shift`` moves polygons along the grid."""
    at = [k for k, p in enumerate(region) if any(len(r) for r in p)]
    boxes = np.zeros((len(at), 4), np.int64)
    grids = []
    for i, k in enumerate(at):
        grids.append([np.rint(np.asarray(r, np.float64).reshape(-1, 2) * scale).astype(np.int64) for r in region[k] if len(r)])
        if shift is not None:
            grids[-1] = [r + [shift[k], 0] for r in grids[-1]]
        every = grids[-1][0] if len(grids[-1]) == 1 else np.concatenate(grids[-1])
        boxes[i, :2], boxes[i, 2:] = every.min(axis=0), every.max(axis=0)
    meets = np.zeros(len(at), bool)
    for i, j in near_edges(boxes):
        meets[i] = meets[j] = True
    lone, rest = {}, []
    for i, k in enumerate(at):
        ring = grids[i][0]
        if not meets[i] and len(grids[i]) == 1:
            ring = ring[(ring != np.roll(ring, 1, axis=0)).any(axis=1)]
            ring = ring if ring_area(ring) > 0 else ring[::-1]
            if is_convex(ring):
                lone[k] = np.roll(ring, -int(np.lexsort((ring[:, 1], ring[:, 0]))[0]), axis=0)
                continue
        rest.append(k)
    return lone, rest


def _sides(a: list[Polygon], b: list[Polygon], how: str, scale: float) -> tuple[list[np.ndarray], list[tuple[tuple, tuple]]]:
    """The result's border on the grid: rings of polygons that meet no other, and directed edges with the result on their left."""
    n = len(a)
    lone, rest = _lone([*a, *b], scale)
    ea, oa = _edges([a[k] for k in rest if k < n], scale, 0)
    first = sum(k < n for k in rest)
    eb, ob = _edges([b[k - n] for k in rest if k >= n], scale, first)
    edges, owner = noded(np.concatenate([ea, eb]), np.concatenate([oa, ob]))

    def inside(label: frozenset) -> bool:
        x, y = any(k < first for k in label), any(k >= first for k in label)
        return (x or y) if how == "union" else (x and y) if how == "intersection" else (x and not y) if how == "difference" else x != y

    known: dict[frozenset, bool] = {}
    sides = []
    for left, right, below, above in labelled(edges, owner):
        low, high = (known.setdefault(s, inside(s)) for s in (below, above))
        if low != high:
            sides.append((left, right) if high else (right, left))
    stays = {"union": lambda k: True, "intersection": lambda k: False, "difference": lambda k: k < n}.get(how, lambda k: True)
    return [r for k, r in lone.items() if stays(k)], sides


def overlay(a: list[Polygon], b: list[Polygon], how: str, scale: float | None = None) -> list[Polygon]:
    """Where polygons of ``a`` or of ``b`` are ("union"), of both ("intersection"), of a but not of b ("difference"), or of one of them ("apart").

    Polygons with holes, which don't overlap; outer rings run counter-clockwise, holes clockwise. Convex polygons that meet no other are not swept.
    """
    scale = scale or grid_scale(a, b)
    return _whole(*_sides(a, b, how, scale), scale)


def unions(regions: list[list[Polygon]]) -> tuple[float, list[tuple[list[np.ndarray], list[tuple[tuple, tuple]]]]]:
    """Unions of many small regions by one sweep: the grid's scale, and for each its border there as ``_sides`` gives it. On the grid regions lie side by side, so that none meets another."""
    scale, apart = grid_scale(*regions), 4 * MOST
    polygons = [p for region in regions for p in region]
    of = np.repeat(np.arange(len(regions)), [len(r) for r in regions])
    lone, rest = _lone(polygons, scale, of * apart)
    out: list[tuple[list, list]] = [([], []) for _ in regions]
    for k, r in lone.items():
        out[of[k]][0].append(r - [of[k] * apart, 0])
    edges, owner = _edges([polygons[k] for k in rest], scale, 0)
    shift = of[np.array(rest, np.int64)][owner] * apart
    edges[:, 0] += shift
    edges[:, 2] += shift
    for (x, y), (u, v), below, above in labelled(*noded(edges, owner)):
        if bool(below) != bool(above):
            k = (x + apart // 2) // apart
            left, right = (x - k * apart, y), (u - k * apart, v)
            out[k][1].append((left, right) if above else (right, left))
    return scale, out


def _sides_area(lone: list[np.ndarray], sides: list[tuple[tuple, tuple]], scale: float) -> float:
    twice = sum(p[0] * q[1] - q[0] * p[1] for p, q in sides) + sum(round(2 * ring_area(r)) for r in lone)
    return twice / 2 / scale / scale


def _whole(lone: list[np.ndarray], sides: list[tuple[tuple, tuple]], scale: float) -> list[Polygon]:
    whole = sorted([[r] for r in lone] + assembled(_rings(sides)), key=lambda p: (ring_area(p[0]), *p[0][0].tolist()))
    return [[r / scale for r in p] for p in whole]


def union_areas(regions: list[list[Polygon]]) -> list[float]:
    """The areas of the unions of many small regions; exact on the grid."""
    scale, borders = unions(regions)
    return [_sides_area(*b, scale) for b in borders]


def united(regions: list[list[Polygon]]) -> list[list[Polygon]]:
    """The unions of many small regions, as ``overlay`` gives them."""
    scale, borders = unions(regions)
    return [_whole(*b, scale) for b in borders]


def overlay_area(a: list[Polygon], b: list[Polygon], how: str, scale: float | None = None) -> float:
    """The area of ``overlay``, without putting its rings together; exact on the grid."""
    scale = scale or grid_scale(a, b)
    return _sides_area(*_sides(a, b, how, scale), scale)


def shares_of_first(polygons: list[Polygon], generation: list[int]) -> list[tuple[float, int]]:
    """What polygons of smaller generations leave of each polygon, by one sweep over all: area and number of parts. Polygons of one generation don't clip each other."""
    scale = grid_scale(polygons)
    lone, rest = _lone(polygons, scale)
    out = [(0.0, 0)] * len(polygons)
    for k, r in lone.items():
        out[k] = (ring_area(r) / scale / scale, 1)
    edges, owner = noded(*_edges([polygons[k] for k in rest], scale, 0))
    of = [generation[k] for k in rest]

    def winners(label: frozenset) -> frozenset:
        least = min((of[k] for k in label), default=None)
        return frozenset(k for k in label if of[k] == least)

    known: dict[frozenset, frozenset] = {}
    sides: dict[int, list[tuple[tuple, tuple]]] = {}
    for left, right, below, above in labelled(edges, owner):
        low, high = known.get(below), known.get(above)
        if low is None:
            low = known[below] = winners(below)
        if high is None:
            high = known[above] = winners(above)
        for k in low - high:
            sides.setdefault(k, []).append((right, left))
        for k in high - low:
            sides.setdefault(k, []).append((left, right))
    for k, some in sides.items():
        twice = sum(p[0] * q[1] - q[0] * p[1] for p, q in some)
        out[rest[k]] = (twice / 2 / scale / scale, sum(ring_area(r) > 0 for r in _rings(some)))
    return out


def region_area(region: Iterable[Polygon]) -> float:
    """The area of polygons as ``overlay`` gives them."""
    return sum(ring_area(r) for p in region for r in p)


def length_within(region: Iterable[Polygon], x0: float, y0: float, x1: float, y1: float) -> float:
    """The length of a region's border within x0 <= x < x1, y0 <= y < y1."""
    total = 0.0
    for r in (r for p in region for r in p):
        d = np.roll(r, -1, axis=0) - r
        low, high = np.zeros(len(r)), np.ones(len(r))
        for k, (a, b) in enumerate(((x0, x1), (y0, y1))):
            flat = d[:, k] == 0
            step = np.where(flat, 1.0, d[:, k])
            s, t = (a - r[:, k]) / step, (b - r[:, k]) / step
            low = np.maximum(low, np.where(flat, np.where((a <= r[:, k]) & (r[:, k] < b), 0.0, 2.0), np.minimum(s, t)))
            high = np.minimum(high, np.where(flat, 1.0, np.maximum(s, t)))
        total += float((np.hypot(*d.T) * np.maximum(high - low, 0.0)).sum())
    return total


# Simplification that keeps topology -----------------------------------------------------------------------------------


def _thinned(ring: np.ndarray, tolerance: float) -> np.ndarray:
    from .spatial import simplify

    s = simplify(ring, tolerance)
    return s if len(s) >= 3 and ring_area(s) * ring_area(ring) > 0 else ring


def _clashes(rings: list[np.ndarray], scale: float) -> set[int]:
    """Rings that cross or overlap themselves or each other, and holes that are no longer within their outer ring (the first)."""
    edges, owner = _edges([[r] for r in rings], scale, 0)
    bad: set[int] = set()
    for i, j in near_edges(edges):
        pi, qi, pj, qj = edges[i, :2], edges[i, 2:], edges[j, :2], edges[j, 2:]
        s = [np.sign(c) for c in (_cross(pi, qi, pj), _cross(pi, qi, qj), _cross(pj, qj, pi), _cross(pj, qj, qi))]
        hit = (s[0] * s[1] < 0) & (s[2] * s[3] < 0)
        # Edges on one line that share more than a point.
        low, high = np.maximum(np.minimum(pi, qi), np.minimum(pj, qj)), np.minimum(np.maximum(pi, qi), np.maximum(pj, qj))
        hit |= (s[0] == 0) & (s[1] == 0) & (low <= high).all(axis=1) & (low < high).any(axis=1)
        bad |= set(owner[i[hit]].tolist()) | set(owner[j[hit]].tolist())
    for k, r in enumerate(rings[1:], 1):
        x, y = (r[0] + r[1]) / 2
        if not _holds(rings[0], x, y):
            bad |= {0, k}
    return bad


def thinned(polygon: Polygon, tolerance: float) -> Polygon:
    """The polygon with rings simplified by ``tolerance``; rings that would cross or leave their outer ring are simplified by half as much, and so on, or stay."""
    if tolerance <= 0:
        return polygon
    out = [_thinned(r, tolerance) for r in polygon]
    if all(len(s) == len(r) for s, r in zip(out, polygon, strict=True)):
        return polygon
    scale, at = grid_scale([polygon]), [tolerance] * len(polygon)
    if len(out) == 1 and is_convex(np.rint(out[0] * scale).astype(np.int64)):
        return out
    while bad := {k for k in _clashes(out, scale) if at[k] > 0}:
        for k in bad:
            at[k] = at[k] / 2 if at[k] > tolerance / 16 else 0.0
            out[k] = _thinned(polygon[k], at[k])
    return out


def published(region: list[Polygon], ladder: tuple[float, ...] = (1.0, 0.5, 0.25, 0.0), most_change: float = 0.01) -> tuple[list[Polygon], float, float]:
    """The region at the coarsest step of the ladder that changes its area by no more than ``most_change``: polygons, step, change."""
    whole = region_area(region)
    for step in ladder:
        some = [thinned(p, step) for p in region]
        change = abs(region_area(some) - whole) / whole if whole else 0.0
        if change <= most_change:
            break
    return some, step, change


# DataFrames -----------------------------------------------------------------------------------------------------------


def as_region(cells: Iterable) -> list[Polygon]:
    """Polygons from values of a column of rings; points are [x, y]."""
    return [[np.array([list(p) for p in ring], np.float64) for ring in rings] for rings in cells]


def as_rings(polygon: Polygon) -> list:
    return [r.tolist() for r in polygon]


def square(x0: float, y0: float, x1: float, y1: float) -> Polygon:
    return [np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], np.float64)]


def _box(region: list[Polygon]) -> np.ndarray:
    points = np.concatenate([np.zeros((0, 2)), *[r for p in region for r in p]])
    return np.concatenate([points.min(axis=0), points.max(axis=0)]) if len(points) else np.array([np.inf, np.inf, -np.inf, -np.inf])


def _within(inner: np.ndarray, outer: tuple[float, float, float, float]) -> bool:
    return bool(inner[0] >= outer[0] and inner[1] >= outer[1] and inner[2] <= outer[2] and inner[3] <= outer[3])


def tiles(rings: Column, size: float) -> Column:
    """The tiles (structs tx, ty) of a grid that a polygon's box touches."""
    xs, ys = F.transform(F.flatten(rings), lambda p: p[0]), F.transform(F.flatten(rings), lambda p: p[1])
    span = lambda v: F.sequence(F.floor(F.array_min(v) / size), F.floor(F.array_max(v) / size))
    return F.flatten(F.transform(span(xs), lambda tx: F.transform(span(ys), lambda ty: F.struct(tx.alias("tx"), ty.alias("ty")))))


def _fields(df: DataFrame, names: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key in as many partitions as shuffles have, or as there are cores: a polygon is few bytes but much work, so small partitions must not be put together."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def dissolved(parts: DataFrame, keys: list[str], tile: float) -> DataFrame:
    """The union of polygons per group of keys, tile by tile: keys, tx, ty, part, rings, area, perimeter (on a tile's first part: what the tile holds of the
    union's border, without the tile's own).

    ``parts`` has the keys and rings. Polygons are dealt to the tiles that they touch and cut to them, so a group that covers any stretch of the plane is
    shared among tasks; unions of neighbouring tiles only touch, so areas and perimeters add up. One row per polygon of the result (of a tile that holds nothing but some
    border, one without rings). Rings of fewer
    than three points, and empty or null ones, cover nothing.
    """
    dealt = parts.filter(F.size("rings") > 0).select(*keys, "rings", F.explode(tiles(F.col("rings"), tile)).alias("t")).select(*keys, "t.*", "rings")

    def union(pdf: pd.DataFrame) -> pd.DataFrame:
        tx, ty = int(pdf["tx"].iloc[0]), int(pdf["ty"].iloc[0])
        box = (tx * tile, ty * tile, (tx + 1) * tile, (ty + 1) * tile)
        whole = overlay(as_region(pdf["rings"]), [], "union")
        edge = length_within(whole, *box)
        rows = []
        for k, p in enumerate(whole if _within(_box(whole), box) else overlay(whole, [square(*box)], "intersection")):
            rows.append({**{c: pdf[c].iloc[0] for c in [*keys, "tx", "ty"]}, "part": k, "rings": as_rings(p), "area": region_area([p]), "perimeter": 0.0 if k else edge})
        if edge and not rows:
            rows.append({**{c: pdf[c].iloc[0] for c in [*keys, "tx", "ty"]}, "part": 0, "rings": [], "area": 0.0, "perimeter": edge})
        return pd.DataFrame(rows, columns=[*keys, "tx", "ty", "part", "rings", "area", "perimeter"])

    return _dealt(dealt, *keys, "tx", "ty").groupBy(*keys, "tx", "ty").applyInPandas(union, f"{_fields(dealt, [*keys, 'tx', 'ty'])}, part int, rings {RINGS}, area double, perimeter double")


def newest_first(parts: DataFrame, keys: list[str], object_id: str, version: str, tile: float) -> DataFrame:
    """What newer versions leave of each polygon, tile by tile: keys, object_id, version, tx, ty, part, rings, area.

    Within a group of keys a polygon loses what polygons of any newer version cover; polygons of one version don't clip each other. As the versions that
    clip are whole, no order of work is needed within a tile but that of versions. What vanishes has no row.
    """
    names = [*keys, object_id, version]
    dealt = parts.filter(F.size("rings") > 0).select(*names, "rings", F.explode(tiles(F.col("rings"), tile)).alias("t")).select(*names, "t.*", "rings")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        tx, ty = int(pdf["tx"].iloc[0]), int(pdf["ty"].iloc[0])
        box = (tx * tile, ty * tile, (tx + 1) * tile, (ty + 1) * tile)
        newer, boxes = [], np.zeros((0, 4))
        rows = []
        for _, g in sorted(pdf.groupby(version), key=lambda x: x[0], reverse=True):
            fresh = []
            for row, p in zip(g.itertuples(index=False), as_region(g["rings"]), strict=True):
                mine = _box([p])
                # Only polygons whose boxes meet can clip; they may overlap each other.
                met = np.flatnonzero((boxes[:, 0] <= mine[2]) & (mine[0] <= boxes[:, 2]) & (boxes[:, 1] <= mine[3]) & (mine[1] <= boxes[:, 3]))
                left = overlay([p], [newer[i] for i in met], "difference")
                if not _within(mine, box):
                    left = overlay(left, [square(*box)], "intersection")
                for k, part in enumerate(left):
                    rows.append({**{c: getattr(row, c) for c in [*names, "tx", "ty"]}, "part": k, "rings": as_rings(part), "area": region_area([part])})
                fresh.append((p, mine))
            newer += [p for p, _ in fresh]
            boxes = np.vstack([boxes, *[b for _, b in fresh]])
        return pd.DataFrame(rows, columns=[*names, "tx", "ty", "part", "rings", "area"])

    return _dealt(dealt, *keys, "tx", "ty").groupBy(*keys, "tx", "ty").applyInPandas(fold, f"{_fields(dealt, [*names, 'tx', 'ty'])}, part int, rings {RINGS}, area double")
