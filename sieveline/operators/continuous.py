"""What a continuous label needs: information by two-dimensional neighbours, and the lasso on cross-products."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sieveline.frame import FeatureFrame
from sieveline.functions import kernels as K
from sieveline.session import ship

from .ranking import running_count, stored

#: Rows of a cell in the search for neighbours in one task's arrays, and of a region in the spread search.
CELL, SPREAD_CELL = 256, 65_536


# --- information -------------------------------------------------------------------------------
#
# The distance of two rows is the greater of |x - x'| and |y - y'|, each multiplied by the other column's deviation, so that
# equal differences give equal distances however the deviations round. A row's radius reaches its k-th neighbour; counted
# are rows whose x (or y) lies strictly inside it, or of equal value where the radius is 0.


def _deviation(v: np.ndarray) -> float:
    return float(v.std()) or 1.0


def _nearest(dx: np.ndarray, dy: np.ndarray, sx: float, sy: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of differences the k nearest: distance, |dx|, |dy|."""
    dx, dy = np.abs(dx), np.abs(dy)
    d = np.maximum(dx * sy, dy * sx)
    at = np.argpartition(d, k - 1, 1)[:, :k] if d.shape[1] > k else np.broadcast_to(np.arange(d.shape[1]), d.shape)
    at = np.take_along_axis(at, np.argsort(np.take_along_axis(d, at, 1), 1, kind="stable"), 1)
    return tuple(np.take_along_axis(v, at, 1) for v in (d, dx, dy))


def _radii(d: np.ndarray, dx: np.ndarray, dy: np.ndarray, sx: float, sy: float) -> tuple[np.ndarray, np.ndarray]:
    """The radius in x and in y; that of the column which the distance comes from is the difference itself."""
    by_x = dx * sy >= dy * sx
    return np.where(by_x, dx, d / sy), np.where(by_x, d / sx, dy)


def _inside(v: np.ndarray, r: np.ndarray) -> np.ndarray:
    s = np.sort(v)
    near = np.searchsorted(s, v + r, "left") - np.searchsorted(s, v - r, "right")
    same = np.searchsorted(s, v, "right") - np.searchsorted(s, v, "left")
    return np.where(r > 0, near, same)


def pair_radii(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's radius in x and in y, exact: cells of equal size give a bound, and only rows within it can be nearer."""
    n, sx, sy = len(x), _deviation(x), _deviation(y)
    best = np.full((3, n), np.inf)
    by_x, by_y = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
    open_ = np.ones(n, bool)
    for band in np.array_split(by_x, max(1, round((n / CELL) ** 0.5))):
        band = band[np.argsort(y[band], kind="stable")]
        for cell in np.array_split(band, max(1, len(band) // CELL)):
            if len(cell) <= k:
                continue
            own = np.arange(len(cell))
            dx, dy = x[cell][:, None] - x[cell], y[cell][:, None] - y[cell]
            dx[own, own] = np.inf
            found = _nearest(dx, dy, sx, sy, k)
            best[:, cell] = [f[:, k - 1] for f in found]
            u = best[0, cell]
            # A cell's rectangle may be left by the radius, and its edge may lie within equal values.
            open_[cell] = (u > 0) & ((x[cell] - u / sy <= x[cell].min()) | (x[cell] + u / sy >= x[cell].max()) | (y[cell] - u / sx <= y[cell].min()) | (y[cell] + u / sx >= y[cell].max()))
    sorted_x, sorted_y = x[by_x], y[by_y]
    wide = 1 + 1e-9
    at = np.flatnonzero(open_)
    ux, uy = best[0, at] / sy * wide, best[0, at] / sx * wide
    windows = [(np.searchsorted(s, v[at] - u, "left"), np.searchsorted(s, v[at] + u, "right"), order) for s, v, u, order in ((sorted_x, x, ux, by_x), (sorted_y, y, uy, by_y))]
    narrow = windows[1][1] - windows[1][0] < windows[0][1] - windows[0][0]
    for j, i in enumerate(at):
        lo, hi, order = windows[int(narrow[j])]
        near = order[lo[j] : hi[j]]
        near = near[near != i]
        found = _nearest((x[near] - x[i])[None], (y[near] - y[i])[None], sx, sy, k)
        best[:, i] = [f[0, k - 1] for f in found]
    return _radii(*best, sx, sy)


def pair_information(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Nearest-neighbour estimate of the mutual information of two numbers, at least 0; 0 for fewer than two rows."""
    from .causal import _harmonic

    k = min(k, len(x) - 1)
    if k < 1:
        return 0.0
    rx, ry = pair_radii(x, y, k)
    value = _harmonic(np.array([len(x)]))[0] + _harmonic(np.array([k]))[0] - _harmonic(_inside(x, rx)).mean() - _harmonic(_inside(y, ry)).mean()
    return float(max(0.0, value))


def counts_inside(rows: DataFrame, value: str, radius: str) -> DataFrame:
    """(f, id, m): rows of f whose value is strictly within a row's radius, or equal to its value where the radius is 0.

    A row marks where its values begin and end among all values of f; kind orders marks among equal values.
    """
    flat, v, r = F.col(radius) <= 0, F.col(value), F.col(radius)
    marks = F.array(
        F.struct(v.alias("v"), F.lit(1).alias("kind"), F.lit(0).alias("sign")),
        F.struct((v - r).alias("v"), F.when(flat, 0).otherwise(2).alias("kind"), F.lit(-1).alias("sign")),
        F.struct((v + r).alias("v"), F.when(flat, 2).otherwise(0).alias("kind"), F.lit(1).alias("sign")),
    )
    line = rows.select("f", "id", F.explode(marks).alias("m")).select("f", "id", "m.*")
    counted = running_count(line, ["f"], ["v", "kind"], "n", F.col("kind") == 1).where("sign != 0")
    return counted.groupBy("f", "id").agg(F.sum(F.col("n") * F.col("sign")).alias("m"))


# --- information of many rows --------------------------------------------------------------------
#
# A bounded sample splits the plane into regions of about equally many rows, and each column into ranges of values. A row meets its region's rows
# first, in leaves of LEAF rows; only if its radius leaves the region is it sent to the others that it reaches. Counts inside the radius
# come from the value's own range, whole ranges by their size, and the ranges at both ends, which a row is sent to only if it reaches them.

#: Rows of a leaf; rows that the splits are taken from, at most, and for each region.
LEAF, SAMPLE, PER_REGION = 32, 400_000, 64
#: Tasks that the rows of one frequent value are dealt to.
_SALTS = 16
_WIDE = 1 + 1e-9


class _Leaves:
    """Points in slabs by x and leaves by y, with the leaves' rectangles; `at` numbers the points of a leaf, -1 where there is none."""

    def __init__(self, x: np.ndarray, y: np.ndarray, size: int = LEAF) -> None:
        n = len(x)
        slabs = max(1, round((n / size) ** 0.5))
        order = np.lexsort((y, x))
        slab = np.arange(n) * slabs // max(1, n)
        order = order[np.lexsort((x[order], y[order], slab))]
        place = np.arange(n) - np.searchsorted(slab, slab)
        leaf = np.cumsum(np.append(0, (place[1:] % size == 0) | (slab[1:] != slab[:-1]))) if n else np.zeros(0, int)
        self.at = np.full((int(leaf[-1]) + 1 if n else 0, size), -1)
        self.at[leaf, place % size] = order
        self.there = self.at >= 0
        self.x, self.y = (np.where(self.there, v[self.at], np.inf) if n else np.zeros((0, size)) for v in (x, y))
        low = lambda v: v.min(1, initial=np.inf)
        high = lambda v: np.where(self.there, v, -np.inf).max(1, initial=-np.inf)
        self.box = np.stack([low(self.x), high(self.x), low(self.y), high(self.y)])


def _own_leaves(leaves: _Leaves, best: np.ndarray, sx: float, sy: float, k: int) -> None:
    """The k nearest of every point among its leaf's others, into best (d, |dx|, |dy|; point; place)."""
    size = leaves.at.shape[1]
    own = np.arange(size)
    for lo in range(0, len(leaves.at), 256):
        s = slice(lo, lo + 256)
        with np.errstate(invalid="ignore"):
            dx, dy = (np.abs(v[s, :, None] - v[s, None, :]) for v in (leaves.x, leaves.y))
        d = np.maximum(dx * sy, dy * sx)
        d[np.isnan(d)] = np.inf
        d[:, own, own] = np.inf
        at = np.argpartition(d, min(k, size) - 1, 2)[:, :, :k]
        at = np.take_along_axis(at, np.argsort(np.take_along_axis(d, at, 2), 2, kind="stable"), 2)
        there = leaves.there[s]
        points = leaves.at[s][there]
        for into, v in zip(best, (d, dx, dy), strict=True):
            into[points, : at.shape[2]] = np.take_along_axis(v, at, 2)[there]


def _from_leaves(asks: _Leaves, held: _Leaves, x: np.ndarray, y: np.ndarray, best: np.ndarray, sx: float, sy: float, same: bool) -> None:
    """Put nearer points of the held leaves into the best of the asking ones, whose numbers x and y go by."""
    k = best.shape[2]
    x0, x1, y0, y1 = held.box
    for lo in range(0, len(asks.at), 128):
        at, there = asks.at[lo : lo + 128], asks.there[lo : lo + 128]
        u = np.where(there, best[0, at, k - 1], 0.0)
        far = u.max(1)
        ux, uy = far / sy * _WIDE, far / sx * _WIDE
        a0, a1, b0, b1 = asks.box[:, lo : lo + 128]
        met = (x0 <= (a1 + ux)[:, None]) & (x1 >= (a0 - ux)[:, None]) & (y0 <= (b1 + uy)[:, None]) & (y1 >= (b0 - uy)[:, None]) & (far > 0)[:, None]
        if same:
            met[np.arange(len(at)), np.arange(lo, lo + len(at))] = False
        a, b = np.nonzero(met)
        point = np.where(there[a], at[a], -1)
        leaf = np.broadcast_to(b[:, None], point.shape)
        keep = (point >= 0) & (best[0, point, k - 1] > 0)
        point, leaf = point[keep], leaf[keep]
        reach = _reaches(x[point], y[point], best[0, point, k - 1], held.box[:, leaf], sx, sy)
        point, leaf = point[reach], leaf[reach]
        order = np.argsort(point, kind="stable")
        point, leaf = point[order], leaf[order]
        turn = np.arange(len(point)) - np.searchsorted(point, point)
        by_turn = np.argsort(turn, kind="stable")
        for t in np.split(by_turn, np.cumsum(np.bincount(turn))[:-1]) if len(turn) else []:
            p, l = point[t], leaf[t]
            still = _reaches(x[p], y[p], best[0, p, k - 1], held.box[:, l], sx, sy)
            p, l = p[still], l[still]
            dx, dy = np.abs(x[p, None] - held.x[l]), np.abs(y[p, None] - held.y[l])
            d = np.maximum(dx * sy, dy * sx)
            better = d.min(1, initial=np.inf) < best[0, p, k - 1]
            p = p[better]
            every = [np.concatenate((old[p], new[better]), 1) for old, new in zip(best, (d, dx, dy), strict=True)]
            near = np.argpartition(every[0], k - 1, 1)[:, :k]
            near = np.take_along_axis(near, np.argsort(np.take_along_axis(every[0], near, 1), 1, kind="stable"), 1)
            for into, v in zip(best, every, strict=True):
                into[p] = np.take_along_axis(v, near, 1)


def _reaches(x: np.ndarray, y: np.ndarray, u: np.ndarray, box: np.ndarray, sx: float, sy: float) -> np.ndarray:
    ux, uy = u / sy * _WIDE, u / sx * _WIDE
    return (box[0] <= x + ux) & (box[1] >= x - ux) & (box[2] <= y + uy) & (box[3] >= y - uy)


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs that are ordered by a, then b."""
    out = np.empty(len(a), complex)
    out.real, out.imag = a, b
    return out


def _dealt(edges: np.ndarray, v: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The part of each value between edges; values equal to edges are dealt over the parts that these bound."""
    lo, hi = np.searchsorted(edges, v, "left"), np.searchsorted(edges, v, "right")
    return lo + h % (hi - lo + 1)


def _cuts(v: np.ndarray, parts: int) -> np.ndarray:
    return np.sort(v)[np.arange(1, parts) * len(v) // parts] if parts > 1 and len(v) else v[:0]


def _pair_cuts(v: np.ndarray, parts: int) -> np.ndarray:
    """Cuts of pairs; a first number that many pairs share and a cut meets has parts of its own."""
    cuts = _cuts(v, parts)
    if not len(cuts):
        return cuts
    value, times = np.unique(v.real, return_counts=True)
    heavy = value[(2 * parts * times >= len(v)) & np.isin(value, cuts.real)]
    return np.sort(np.concatenate([cuts, *(_paired(heavy, np.full(len(heavy), end)) for end in (-np.inf, np.inf))]))


def _bounds(cuts: np.ndarray) -> np.ndarray:
    """Least and greatest first number of each part between cuts, then of the second number, which are those of cuts that share the first."""
    low = np.append(-np.inf, np.where(cuts.imag == np.inf, np.nextafter(cuts.real, np.inf), cuts.real))
    high = np.append(np.where(cuts.imag == -np.inf, np.nextafter(cuts.real, -np.inf), cuts.real), np.inf)
    one = low == high
    return np.stack([low, high, np.where(one, np.append(-np.inf, cuts.imag), -np.inf), np.where(one, np.append(cuts.imag, np.inf), np.inf)])


@dataclass
class _Ranges:
    """Ranges of one column's values: from an edge to the next, and each value that is several edges by itself."""

    edges: np.ndarray
    heavy: np.ndarray

    @classmethod
    def of(cls, v: np.ndarray, parts: int) -> _Ranges:
        edges, times = np.unique(_cuts(v, parts), return_counts=True)
        return cls(edges, times > 1)

    def of_values(self, v: np.ndarray) -> np.ndarray:
        """Range 2i lies between edges i - 1 and i (with edge i - 1, unless that is a range), 2i + 1 is edge i."""
        lo, hi = np.searchsorted(self.edges, v, "left"), np.searchsorted(self.edges, v, "right")
        on = np.append(self.heavy, False)[np.minimum(lo, len(self.edges))]
        return np.where((hi > lo) & ~on, 2 * hi, lo + hi)

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every range the least a value can be, and what all are below (or equal to, if it is one value)."""
        e = np.concatenate(([-np.inf], np.repeat(self.edges, 2), [np.inf]))
        return e[:-1], e[1:]


@dataclass
class _Plane:
    """Regions and ranges of one feature and the label."""

    n: int
    sx: float
    sy: float
    first: int  # number of the first region
    slabs: np.ndarray
    rows: list[np.ndarray]
    ranges: tuple[_Ranges, _Ranges]

    def __post_init__(self) -> None:
        sizes = [len(r) + 1 for r in self.rows]
        self.starts = self.first + np.cumsum([0, *sizes])
        slab = np.repeat(_bounds(self.slabs), sizes, axis=1)
        row = np.concatenate([_bounds(r) for r in self.rows], axis=1)[[2, 3, 0, 1]]
        self.box = np.where(np.array([True, False, True, False])[:, None], np.maximum(slab, row), np.minimum(slab, row))

    def others(self, box: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, u: np.ndarray, g: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, region) of the rows `at` and the regions but their own (g) whose box their radius reaches, a part of the rows at a time."""
        step = max(1, 4_000_000 // self.box.shape[1])
        for lo in range(0, len(at), step):
            m = at[lo : lo + step]
            hit = _reaches(x[m, None], y[m, None], u[m, None], box[:, None, :], self.sx, self.sy)
            hit[np.arange(len(m)), g[m] - self.first] = False
            a, b = np.nonzero(hit)
            yield m[a], self.first + b

    def region(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> np.ndarray:
        h = (ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)
        slab = _dealt(self.slabs, _paired(x, y), h)
        out = np.zeros(len(x), np.int64)
        for s in np.unique(slab):
            mine = slab == s
            out[mine] = self.starts[s] + _dealt(self.rows[s], _paired(y[mine], x[mine]), h[mine] >> 8)
        return out


def _splits(x: np.ndarray, y: np.ndarray, many: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Edges of slabs, and of the regions of each; points equal to edges are dealt over slabs, as rows are."""
    slabs = _pair_cuts(_paired(x, y), max(1, round(many**0.5)))
    slab = _dealt(slabs, _paired(x, y), np.arange(len(x)))
    share = np.bincount(slab, minlength=len(slabs) + 1) / max(1, len(x))
    return slabs, [_pair_cuts(_paired(y[slab == s], x[slab == s]), max(1, round(many * share[s]))) for s in range(len(slabs) + 1)]


def _planes(cells: DataFrame, size: int) -> dict[int, _Plane]:
    """Planes of all features with two rows at least, from the rows' numbers and deviations and a sample by hash of their ids."""
    of = cells.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy")).where("n > 1").collect()
    regions = {r["f"]: max(1, round(r["n"] / size)) for r in of}
    share = min(1.0, min(SAMPLE, PER_REGION * sum(regions.values())) / max(1, sum(r["n"] for r in of)))
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))
    found: dict[int, list] = {r["f"]: [] for r in of}
    if max(regions.values(), default=1) > 1:
        for r in cells.where(drawn).select("f", "x", "y").collect():
            found.get(r["f"], []).append((r["x"], r["y"]))
    out, first = {}, 0
    for r in sorted(of, key=lambda r: r["f"]):
        x, y = np.array(found[r["f"]], float).reshape(-1, 2).T
        many = max(1, min(regions[r["f"]], len(x) // 4))
        slabs, rows = _splits(x, y, many)
        plane = _Plane(r["n"], r["sx"] or 1.0, r["sy"] or 1.0, first, slabs, rows, (_Ranges.of(x, many), _Ranges.of(y, many)))
        out[r["f"]], first = plane, int(plane.starts[-1])
    return out


_HITS = pa.list_(pa.struct([("d", pa.float64()), ("dx", pa.float64()), ("dy", pa.float64())]))
_HITS_SPEC = "array<struct<d:double,dx:double,dy:double>>"


def _columns(t: pa.Table | pa.RecordBatch, *names: str) -> list[np.ndarray]:
    columns = [t.column(t.schema.get_field_index(c)) for c in names]
    return [c.to_numpy() if isinstance(c, pa.ChunkedArray) else c.to_numpy(zero_copy_only=False) for c in columns]


def _hits(best: np.ndarray, at: np.ndarray, below: np.ndarray) -> pa.Array:
    """The found (d, dx, dy) of rows `at`, nothing for other rows; those with d less than `below`."""
    n = best.shape[1]
    good = np.zeros(best.shape[1:], bool)
    good[at] = best[0, at] < below[at, None]
    flat = pa.StructArray.from_arrays([pa.array(v[good]) for v in best], fields=list(_HITS.value_type))
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.append(0, good.sum(1))) if n else [0], pa.int32()), flat).cast(_HITS)


def spread_radii(cells: DataFrame, k: int, size: int = SPREAD_CELL, planes: dict[int, _Plane] | None = None) -> DataFrame:
    """(f, id, x, y, n, rx, ry) for any number of rows (f, id, x, y): exact radii from regions of about `size` rows.

    A region is a rectangle between splits by (x, y) and (y, x), so frequent values don't fill one; equal rows that fill several are
    dealt over them. A row's k-th distance in its region bounds its radius, and it is sent only to regions that this reaches: those
    at an edge, a share that falls as regions grow.
    """
    ship(cells.sparkSession)
    planes = _planes(cells, size) if planes is None else planes
    of_region = {int(g): f for f, p in planes.items() for g in range(int(p.starts[0]), int(p.starts[-1]))}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, ids, x, y = _columns(batch, "f", "id", "x", "y")
            g = np.full(len(f), -1, np.int64)
            for c in np.unique(f):
                if int(c) in planes:
                    mine = f == c
                    g[mine] = planes[int(c)].region(x[mine], y[mine], ids[mine])
            out = pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(ids), pa.array(x), pa.array(y)], ["g", "id", "x", "y"])
            yield out if (g >= 0).all() else out.filter(pa.array(g >= 0))

    def inside(t: pa.Table) -> pa.Table:
        g = t.column("g")[0].as_py()
        f, (ids, x, y) = of_region[g], _columns(t, "id", "x", "y")
        p, many = planes[of_region[g]], min(k, planes[of_region[g]].n - 1)
        best = np.full((3, len(x), many), np.inf)
        leaves = _Leaves(x, y)
        _own_leaves(leaves, best, p.sx, p.sy, many)
        _from_leaves(leaves, leaves, x, y, best, p.sx, p.sy, True)
        u = best[0, :, -1]
        x0, x1, y0, y1 = p.box[:, g - p.first]
        ux, uy = u / p.sy * _WIDE, u / p.sx * _WIDE
        open_ = (u > 0) & ((x - ux <= x0) | (x + ux >= x1) | (y - uy <= y0) | (y + uy >= y1)) & (p.box.shape[1] > 1)
        rx, ry = _radii(best[0, :, -1], best[1, :, -1], best[2, :, -1], p.sx, p.sy)
        near = _hits(best, np.flatnonzero(open_), np.full(len(x), np.inf))
        return pa.table({"f": pa.array(np.full(len(x), f), pa.int32()), "g": pa.array(np.full(len(x), g), pa.int32()), "id": ids, "x": x, "y": y, "rx": rx, "ry": ry, "u": pa.array(u), "open": open_, "near": near})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, g, ids, x, y, u = _columns(batch, "f", "g", "id", "x", "y", "u")
            for c in np.unique(f):
                p = planes[int(c)]
                for a, b in p.others(boxes[int(c)], np.flatnonzero(f == c), x, y, u, g):
                    yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), *(pa.array(v[a]) for v in (f, ids, x, y, u))], ["g", "f", "id", "x", "y", "u"])

    def sharpen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, g, x, y, u = _columns(batch, "f", "g", "x", "y", "u")
            open_ = np.zeros(len(f), bool)
            for c in np.unique(f):
                for a, _ in planes[int(c)].others(boxes[int(c)], np.flatnonzero(f == c), x, y, u, g):
                    open_[a] = True
            yield batch.set_column(batch.schema.get_field_index("open"), "open", pa.array(open_))

    def across(asks: pa.Table, held: pa.Table) -> pa.Table:
        f, ids, x, y, u = _columns(asks, "f", "id", "x", "y", "u")
        if not len(ids):
            return pa.table({"f": pa.array([], pa.int32()), "id": pa.array([], pa.int64()), "near": pa.array([], _HITS)})
        p = planes[int(f[0])]
        best = np.full((3, len(x), min(k, p.n - 1)), np.inf)
        best[0] = u[:, None]
        _from_leaves(_Leaves(x, y), _Leaves(*_columns(held, "x", "y")), x, y, best, p.sx, p.sy, False)
        return pa.table({"f": pa.array(f, pa.int32()), "id": ids, "near": _hits(best, np.arange(len(x)), u)})

    dealt = cells.select("f", "id", "x", "y").mapInArrow(deal, "g int, id long, x double, y double")
    spec = f"f int, g int, id long, x double, y double, rx double, ry double, u double, open boolean, near {_HITS_SPEC}"
    own = stored(dealt.groupBy("g").applyInArrow(inside, spec), "near")
    n = F.create_map(*[F.lit(v) for f, p in planes.items() for v in (int(f), int(p.n))])[F.col("f")].cast("long").alias("n") if planes else F.lit(0).cast("long").alias("n")
    columns = ("f", "id", "x", "y", n, "rx", "ry")
    # Splits bound a region loosely where a feature has few values; its rows' own box says which askers it can serve.
    boxes = {f: np.repeat([[np.inf], [-np.inf], [np.inf], [-np.inf]], p.box.shape[1], 1) for f, p in planes.items()}
    for r in own.groupBy("f", "g").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).collect():
        boxes[r["f"]][:, r["g"] - planes[r["f"]].first] = r["x0"], r["x1"], r["y0"], r["y1"]
    doubtful = own.where("open").mapInArrow(sharpen, spec)
    asking = doubtful.where("open")
    shut = own.where("not open").select(*columns).unionByName(doubtful.where("not open").select(*columns))
    if asking.isEmpty():
        return shut
    asks = stored(asking.select("f", "g", "id", "x", "y", "u").mapInArrow(ask, "g int, f int, id long, x double, y double, u double"), "asks")
    # A region may be asked by many more rows than it has: these come in chunks, each with the region's rows.
    chunks = F.broadcast(asks.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("chunks")))
    parts = asks.join(chunks, "g").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).drop("chunks")
    held = dealt.join(chunks, "g").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    found = parts.groupBy("g", "chunk").cogroup(held.groupBy("g", "chunk")).applyInArrow(across, f"f int, id long, near {_HITS_SPEC}")
    met = asking.select("f", "id", "near").unionByName(found).groupBy("f", "id").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("all"))
    best = met.join(asking.select("f", "id", "x", "y", n), ["f", "id"]).withColumn("k", F.get("all", F.least(F.lit(k), F.col("n") - 1).cast("int") - 1))
    of = lambda name: F.create_map(*[F.lit(v) for f, p in planes.items() for v in (int(f), float(getattr(p, name)))])[F.col("f")]
    by_x = F.col("k.dx") * of("sy") >= F.col("k.dy") * of("sx")
    wider = best.select("f", "id", "x", "y", "n", F.when(by_x, F.col("k.dx")).otherwise(F.col("k.d") / of("sy")).alias("rx"), F.when(by_x, F.col("k.d") / of("sx")).otherwise(F.col("k.dy")).alias("ry"))
    return shut.unionByName(wider)


def _digammas(n: np.ndarray) -> np.ndarray:
    """Digamma of whole numbers, but for Euler's constant."""
    from .causal import _harmonic

    x = np.maximum(n, 1).astype(float)
    series = np.log(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x) + float(np.euler_gamma)
    return np.where(n <= 30, _harmonic(np.minimum(n, 30)), series)


def mean_digammas(rows: DataFrame, planes: dict[int, _Plane]) -> dict[tuple[int, int], float]:
    """The mean digamma of how many rows lie inside a row's radius, by (f, 0 for x or 1 for y), over stored rows (f, x, y, id, rx, ry).

    A row goes to the range of its value, and to those at the ends of its radius if these are others; ranges between count by
    their size. Rows of a range that is one value need none of it but its size, and are dealt over several groups.
    """
    spaces = {(f, s): p.ranges[s] for f, p in planes.items() for s in (0, 1)}

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {key: (np.zeros(2 * len(r.edges) + 1, np.int64), np.full(2 * len(r.edges) + 1, np.inf), np.full(2 * len(r.edges) + 1, -np.inf)) for key, r in spaces.items()}
        for batch in batches:
            f, *v = _columns(batch, "f", "x", "y")
            for c in np.unique(f):
                for s in (0, 1):
                    n, least, most = total[int(c), s]
                    mine = v[s][f == c]
                    b = spaces[int(c), s].of_values(mine)
                    n += np.bincount(b, minlength=len(n))
                    np.minimum.at(least, b, mine)
                    np.maximum.at(most, b, mine)
        out = [(f, s, b, *r) for (f, s), t in total.items() for b, r in enumerate(zip(*(c.tolist() for c in t), strict=True)) if r[0]]
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], ["f", "s", "b", "n", "least", "most"])

    sizes = {key: np.zeros(2 * len(r.edges) + 1, np.int64) for key, r in spaces.items()}
    span = {key: (np.full(len(n), np.inf), np.full(len(n), -np.inf)) for key, n in sizes.items()}
    met = rows.select("f", "x", "y").mapInArrow(size, "f int, s int, b int, n long, least double, most double")
    for r in met.groupBy("f", "s", "b").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).collect():
        key, b = (r["f"], r["s"]), r["b"]
        sizes[key][b], span[key][0][b], span[key][1][b] = r["n"], r["least"], r["most"]
    names = ["f", "s", "b", "salt", "id", "v", "r", "more", "kind"]
    types = (pa.int32(), pa.int8(), pa.int32(), pa.int8(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int8())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, ids, *numbers = _columns(batch, "f", "id", "x", "y", "rx", "ry")
            for c in np.unique(f):
                mine = f == c
                for s in (0, 1):
                    ranges, i, v, r = spaces[int(c), s], ids[mine], numbers[s][mine], numbers[s + 2][mine]
                    low, high = ranges.ends()
                    before = np.cumsum(np.append(0, sizes[int(c), s]))
                    b = ranges.of_values(v)
                    # The ranges of the least and the greatest value inside; a row's own lies between, or is one of them.
                    under, over = np.searchsorted(low, v - r, "right") - 1, np.searchsorted(low, v + r, "left") - 1
                    first, last = np.where(r > 0, np.minimum(under, b), b), np.where(r > 0, np.maximum(over, b), b)
                    more = np.maximum(before[last] - before[np.minimum(first + 1, last)], 0)  # all ranges between
                    within = (first < b) & (b < last)
                    more = more - np.where(within, sizes[int(c), s][b], 0)
                    least, most = span[int(c), s]
                    ends = [(first, (first < b) & (most[first] > v - r)), (last, (b < last) & (least[last] < v + r))]
                    kind = np.where(ends[0][1] | ends[1][1], 1, 0)
                    parts = [(b, i, v, r, more, kind, np.where(b % 2 == 1, i % _SALTS, 0))]
                    for end, asked in ends:
                        at = np.flatnonzero(asked)
                        parts.append((end[at], i[at], v[at], r[at], np.zeros(len(at), np.int64), np.full(len(at), 2), np.zeros(len(at), np.int64)))
                    b, i, v, r, more, kind, salt = (np.concatenate(p) for p in zip(*parts, strict=True))
                    columns = (np.full(len(b), c), np.full(len(b), s), b, salt, i, v, r, more, kind)
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(t.to_pandas_dtype(), copy=False), t) for x, t in zip(columns, types, strict=True)], names)

    def count(t: pa.Table) -> pa.Table:
        ids, v, r, more, kind = _columns(t, "id", "v", "r", "more", "kind")
        f, s, b = (t.column(c)[0].as_py() for c in ("f", "s", "b"))
        if b % 2:  # one value: all of its rows or none
            edge = spaces[f, s].edges[b // 2]
            hit = np.where(r > 0, (v - r < edge) & (edge < v + r), v == edge)
            m = hit * sizes[f, s][b]
        else:
            held = np.sort(v[kind < 2])
            near = np.searchsorted(held, v + r, "left") - np.searchsorted(held, v - r, "right")
            same = np.searchsorted(held, v, "right") - np.searchsorted(held, v, "left")
            m = np.where(r > 0, np.maximum(near, 0), same)
        m = m + more
        at = np.flatnonzero(kind > 0)
        done = kind == 0
        n = len(at) + 1
        return pa.table({"f": pa.array([f] * n, pa.int32()), "s": pa.array([s] * n, pa.int32()), "id": pa.array([None, *ids[at].tolist()], pa.int64()), "m": pa.array([0, *m[at].tolist()], pa.int64()), "total": [float(_digammas(m[done]).sum()), *[0.0] * len(at)]})

    sent = rows.select("f", "id", "x", "y", "rx", "ry").mapInArrow(deal, "f int, s byte, b int, salt byte, id long, v double, r double, more long, kind byte")
    counted = stored(sent.groupBy("f", "s", "b", "salt").applyInArrow(count, "f int, s int, id long, m long, total double"), "counts")

    def digamma(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, s, m = _columns(batch, "f", "s", "m")
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(s, pa.int32()), pa.array(_digammas(m))], ["f", "s", "total"])

    opened = counted.where("id is not null").groupBy("f", "s", "id").agg(F.sum("m").alias("m")).select("f", "s", "m").mapInArrow(digamma, "f int, s int, total double")
    sums = counted.where("id is null").select("f", "s", "total").unionByName(opened).groupBy("f", "s").agg(F.sum("total").alias("total"))
    return {(r["f"], r["s"]): r["total"] / planes[r["f"]].n for r in sums.collect()}


def continuous_information(frame: FeatureFrame, k: int = 3, direct: int = 200_000, size: int = SPREAD_CELL) -> DataFrame:
    """(f, score): information of each feature about a continuous label, from rows that have both.

    Up to `direct` rows a feature's rows are one group of arrays; beyond, see spread_radii. Both give the same numbers.
    """
    spark = frame.df.sparkSession
    ship(spark)
    if frame.df.count() > direct:
        frame = frame.stored()
        cells = _cells(frame)
        planes = _planes(cells, size)
        means = mean_digammas(stored(spread_radii(cells, k, size, planes), "radii"), planes) if planes else {}
        whole = lambda n: float(_digammas(np.array([n]))[0])
        scores = {f: max(0.0, whole(p.n) + whole(min(k, p.n - 1)) - means[f, 0] - means[f, 1]) for f, p in planes.items()}
        return spark.createDataFrame([(f, scores.get(f, 0.0)) for f in range(frame.p)], "f int, score double")

    def one(t: pa.Table) -> pa.Table:
        return pa.table({"f": pa.array([t.column("f")[0].as_py()], pa.int32()), "score": [pair_information(*_columns(t, "x", "y"), k)]})

    found = _cells(frame).select("f", "x", "y").groupBy("f").applyInArrow(one, "f int, score double")
    every = spark.range(frame.p).select(F.col("id").cast("int").alias("f"))
    return every.join(found, "f", "left").select("f", F.coalesce("score", F.lit(0.0)).alias("score"))


def _cells(frame: FeatureFrame) -> DataFrame:
    return frame.long().where("x is not null and y is not null").select(F.col("f").cast("int").alias("f"), F.col("row_id").cast("long").alias("id"), "x", "y")


# --- lasso -------------------------------------------------------------------------------------------


def lasso(g: K.Gram, penalty: float = 0.01, tolerance: float = 1e-10, sweeps: int = 100_000) -> np.ndarray:
    """Coefficients that minimise half the mean squared error plus `penalty` times their absolute sum, by coordinate descent.

    Works on cross-products, so it needs one scan of the rows whatever its sweeps. Features that don't vary get 0.
    """
    c, b = g.cross[:-1, :-1] / g.n, g.cross[:-1, -1] / g.n
    w, fit = np.zeros(g.p), np.zeros(g.p)  # fit = c @ w
    own = np.diag(c)
    alive = np.flatnonzero(own > 1e-12)
    for _ in range(sweeps):
        moved = 0.0
        for i in alive:
            pull = b[i] - fit[i] + own[i] * w[i]
            new = np.sign(pull) * max(abs(pull) - penalty, 0.0) / own[i]
            if new != w[i]:
                fit += c[:, i] * (new - w[i])
                moved = max(moved, abs(new - w[i]) * own[i] ** 0.5)
                w[i] = new
        if moved <= tolerance * max(1.0, float(g.cross[-1, -1] / g.n) ** 0.5):
            break
    return w
