"""Exact nearest neighbours and counts of nearer rows: cells around pivots, and bounds by the triangle inequality and by boxes.

Rows go to their nearest pivot (of few features: to a leaf of a k-d tree over a sample, whose middle is its pivot), and a pivot's rows, in
the order of their distance from it, to blocks of equal size: rings that a
crowd of equal rows fills several of. All rows of a block lie between two distances from its pivot, so a row that knows
its own distance from the pivot can tell how near the block's rows can be and how far; of few features the least and greatest values of
the block's rows tell it better. A row is sent only to blocks that this
leaves undecided. Blocks travel by parts of up to SUPER of them: a row goes once to a part that has such a block, and meets only these
there, so copies of a row are as many as parts at most, and no more than eight below eight parts of SUPER blocks. Without structure (many features of
noise) rows meet nearly every block, as in any exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sieveline.session import ship

from .ranking import running_count, stored

#: Rows of a block, rows that ask one copy of a part at most, and the most pivots, blocks, and blocks of a part there are.
BLOCK, ASKS, PIVOTS, BLOCKS, SUPER = 2048, 65_536, 1024, 100_000, 64
#: Parts that there are at least if blocks allow, and copies of a part if its askers allow: work for all cores.
_PARTS, _ASKED = 8, 1024
#: Features up to which cells are leaves of a k-d tree and blocks know their boxes, the most leaves, and rows of the sample for each.
BOXED, LEAVES, PER_LEAF = 12, 4096, 32
#: Distances near a bound count as on either side of it, as sums round.
_SLACK = 1e-9


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, summed feature by feature, so that equal differences give equal sums."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        out += (a[:, i : i + 1] - b[None, :, i]) ** 2
    return out


def estimates(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances from one matrix product, and how far they may be from those of squares()."""
    whole = a, b
    with np.errstate(over="ignore", invalid="ignore"):
        middle = b.mean(0) if len(b) else 0.0
        a, b = a - middle, b - middle
        aa, bb = (a * a).sum(1), (b * b).sum(1)
    if not np.isfinite(aa.sum() + bb.sum()):
        return squares(*whole), 0.0
    d = a @ (-2.0 * b.T)
    d += aa[:, None]
    d += bb
    # The distance of two rows is below twice the sum of their squares; each step rounds by 2**-53 of what it adds.
    return d, float((aa.max(initial=0) + bb.max(initial=0)) * (a.shape[1] + 8) * 2.0**-49)


def pair_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """squares() of row i of a and row i of b."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += (a[:, i] - b[:, i]) ** 2
    return out


#: From how many features on a matrix product finds the rows whose distances are summed.
PRODUCT = 8


def matrix(t: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    column = t.column(t.schema.get_field_index(name))
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1)


def _get(t: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    column = t.column(t.schema.get_field_index(name))
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


class Tree:
    """Leaves of about equally many rows of a sample: a split says which feature is below which value."""

    def __init__(self, x: np.ndarray, many: int) -> None:
        self.nodes: list[tuple[int, float, int, int]] = []  # feature, value, node below, node from there on; a leaf: -1, 0, number, number
        self.middles: list[np.ndarray] = []
        self._grow(x, many)
        self.feature, self.value, *children = (np.array(c) for c in zip(*self.nodes, strict=True))
        self.children = np.stack(children, 1)

    def _grow(self, x: np.ndarray, many: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, len(self.middles), len(self.middles)))
        split = self._split(x, many // 2 / many) if many > 1 and len(x) > 1 else None
        if split is None:
            self.middles.append(x.mean(0) if len(x) else np.zeros(x.shape[1]))
            return at
        f, value = split
        below = x[:, f] < value
        left = min(many - 1, max(1, round(many * below.mean())))
        self.nodes[at] = (f, value, self._grow(x[below], left), self._grow(x[~below], many - left))
        return at

    @staticmethod
    def _split(x: np.ndarray, share: float) -> tuple[int, float] | None:
        """The widest feature (between its tenths, or as it deviates if none has width there) and its value at the share."""
        low, high = np.quantile(x, (0.1, 0.9), 0)
        width = high - low if (high > low).any() else x.std(0)
        f = int(width.argmax())
        v = np.sort(x[:, f])
        value = v[int(len(v) * share)]
        if value == v[0]:
            above = v[v > value]
            return (f, float(above[0])) if len(above) else None
        return f, float(value)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not len(inner):
                return self.children[at, 0]
            n = at[inner]
            at[inner] = self.children[n, (x[inner, self.feature[n]] >= self.value[n]).astype(int)]


@dataclass
class Cells:
    """Pivots, and of every block its pivot, place, least and greatest distance from the pivot, and rows; of few features also the
    least and the greatest values of its rows. Sizes are bounded by PIVOTS and BLOCKS."""

    pivots: np.ndarray
    table: np.ndarray
    boxes: np.ndarray | None = None

    @property
    def per(self) -> int:
        """Blocks of a part."""
        return max(1, min(SUPER, len(self.table) // _PARTS))

    def parts(self, hit: np.ndarray) -> np.ndarray:
        """Of flags of blocks, whether any of a part is set."""
        return np.logical_or.reduceat(hit, np.arange(0, len(self.table), self.per), 1)

    def reach(self, x: np.ndarray, blocks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """How near and how far the rows of blocks (all of them, or those of the numbers given) can be from each row of x."""
        table = self.table if blocks is None else self.table[blocks]
        which, at = np.unique(table[:, 0].astype(int), return_inverse=True)
        away = np.sqrt(squares(x, self.pivots[which]))[:, at]
        low, high = table[:, 2], table[:, 3]
        near, far = np.maximum(np.maximum(away - high, low - away), 0), away + high
        if self.boxes is not None:
            boxes = self.boxes if blocks is None else self.boxes[blocks]
            out, across = np.zeros(near.shape), np.zeros(near.shape)
            for i in range(x.shape[1]):
                under, over = boxes[:, 0, i] - x[:, i : i + 1], x[:, i : i + 1] - boxes[:, 1, i]
                out += np.maximum(np.maximum(under, over), 0) ** 2
                across += np.minimum(under, over) ** 2  # the farther side: both are below 0 inside
            near, far = np.maximum(near, np.sqrt(out)), np.minimum(far, np.sqrt(across))
        return near * (1 - _SLACK) - _SLACK, far * (1 + _SLACK) + _SLACK


def cells_of(rows: DataFrame) -> tuple[DataFrame, Cells]:
    """rows, stored, with their pivot, block, and the block's number b, and the blocks. rows has row_id (long), y (int), fold and x."""
    ship(rows.sparkSession)
    rows = rows.select(F.col("row_id").cast("long").alias("row_id"), F.col("y").cast("int").alias("y"), F.col("fold").cast("int").alias("fold"), "x")
    n = rows.count()
    first = rows.select(F.size("x").alias("p")).first()
    p = first["p"] if first else 0
    boxed = 0 < p <= BOXED  # boxes of small blocks leave out most of them
    size = max(BLOCK // 4 if boxed else BLOCK, -(-n // (BLOCKS - LEAVES)))
    many = min(LEAVES if boxed else PIVOTS, max(1, n // size))
    tree = None
    if boxed and many > 1:
        share = min(1.0, PER_LEAF * many / n)
        chosen = rows.where(F.pmod(F.xxhash64("row_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("x").collect()
        tree = Tree(np.array([r["x"] for r in chosen], float).reshape(len(chosen), p), many)
        pivots = np.array(tree.middles)
    else:
        chosen = rows.select("x", F.xxhash64("row_id").alias("h")).orderBy("h").limit(many).collect()
        pivots = np.unique(np.array([r["x"] for r in chosen], float).reshape(len(chosen), -1), axis=0)
    names = ["row_id", "y", "fold", "x", "pivot", "r"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, "x")
            best, away = np.zeros(len(x), np.int32), np.zeros(len(x))
            if tree is not None:
                best = tree.leaf(x).astype(np.int32)
                away = np.sqrt(pair_squares(x, pivots[best]))
            for lo in range(0, len(x) if tree is None else 0, 1024):
                d = squares(x[lo : lo + 1024], pivots)
                best[lo : lo + 1024] = d.argmin(1)
                away[lo : lo + 1024] = np.sqrt(d.min(1))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names[:4]), pa.array(best), pa.array(away)], names)

    near = rows.select(*names[:4]).mapInArrow(assign, "row_id long, y int, fold int, x array<double>, pivot int, r double")
    placed = running_count(near, ["pivot"], ["r", "row_id"], "at").withColumn("block", F.expr(f"cast(at div {size} as int)")).drop("at")
    dealt = stored(placed.select(*names, "block"), "neighbour-cells")
    edges = [e(F.get("x", F.lit(i))).alias(f"{e.__name__}{i}") for e in (F.min, F.max) for i in range(p)] if tree is not None else []
    found = dealt.groupBy("pivot", "block").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count(F.lit(1)).alias("n"), *edges).orderBy("pivot", "block").collect()
    numbers = rows.sparkSession.createDataFrame([(r["pivot"], r["block"], b) for b, r in enumerate(found)], "pivot int, block int, b int")
    table = np.array([tuple(r) for r in found], float).reshape(-1, 5 + len(edges))
    boxes = table[:, 5:].reshape(-1, 2, p) if tree is not None else None
    return dealt.join(F.broadcast(numbers), ["pivot", "block"]), Cells(pivots, table[:, :5], boxes)


_NEAR = pa.list_(pa.struct([("d", pa.float64()), ("other", pa.int64()), ("y", pa.int32())]))


def _closest(d: np.ndarray, k: int, exact=None, error: float = 0.0, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of the k least finite cells of each row of d, the lowest column of equal ones; rows ascend.

    Where d is an estimate, cells within its error of the k-th are looked up by exact(rows, columns). Cells above a row's `most`
    aren't wanted; where all rows have one, the k-th needn't be found.
    """
    kth = min(k, d.shape[1]) - 1
    if kth < 0:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    if most is not None and np.isfinite(most).all() and (most > 0).all():
        a, b = np.nonzero(d <= most[:, None] + 2 * error)
    else:
        a, b = np.nonzero((d <= np.partition(d, kth, 1)[:, kth : kth + 1] + 2 * error) & np.isfinite(d))
    far = exact(a, b) if exact else d[a, b]
    order = np.lexsort((b, far, a))
    a, b, far = a[order], b[order], far[order]
    near = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[near], b[near], far[near]


def _best(found: tuple[np.ndarray, np.ndarray, np.ndarray], rows: int, ids: np.ndarray, y: np.ndarray) -> pa.Array:
    """What _closest has found, as (d, other, y) for each of so many rows; ids ascend."""
    a, b, d = found
    flat = pa.StructArray.from_arrays([pa.array(d), pa.array(ids[b], pa.int64()), pa.array(y[b], pa.int32())], fields=list(_NEAR.value_type))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(a, np.arange(rows + 1)), pa.int32()), flat).cast(_NEAR)


def _compared(x: np.ndarray, ids: np.ndarray, fold: np.ndarray, held: pa.Table, k: int, apart: bool, most: np.ndarray | None = None) -> pa.Array:
    """The k nearest of the held rows for each of the given ones, or those of them whose squared distance isn't above `most`."""
    order = np.argsort(_get(held, "row_id"), kind="stable")
    hx, hid, hy, hf = matrix(held, "x")[order], _get(held, "row_id")[order], _get(held, "y")[order], _get(held, "fold")[order]
    out = []
    for lo in range(0, len(x), 1024):
        s = slice(lo, lo + 1024)
        mine, exact, error = x[s], None, 0.0
        if x.shape[1] < PRODUCT:
            d = squares(mine, hx)
        else:
            d, error = estimates(mine, hx)
            exact = lambda a, b, mine=mine: pair_squares(mine[a], hx[b])
        d[ids[s][:, None] == hid] = np.inf
        if apart:
            d[fold[s][:, None] == hf] = np.inf
        out.append(_best(_closest(d, k, exact, error, None if most is None else most[s]), len(mine), hid, hy))
    return pa.concat_arrays(out) if out else pa.array([], _NEAR)


def _spread(asks: DataFrame, dealt: DataFrame, per: int) -> tuple[DataFrame, DataFrame]:
    """Askers in chunks of ASKS a part at most, and a copy of the part's rows for each chunk."""
    n = F.count(F.lit(1))
    chunks = asks.groupBy("part").agg(F.greatest(F.ceil(n / ASKS), F.least(F.lit(_PARTS), F.ceil(n / _ASKED))).cast("int").alias("chunks"))
    asking = asks.join(F.broadcast(chunks), "part").withColumn("chunk", F.pmod(F.xxhash64("row_id"), F.col("chunks")).cast("int")).drop("chunks")
    held = dealt.withColumn("part", F.expr(f"cast(b div {per} as int)")).join(F.broadcast(chunks), "part").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    return asking, held


def _by_block(held: pa.Table) -> Iterator[tuple[int, pa.Table]]:
    b = _get(held, "b")
    order = np.argsort(b, kind="stable")
    held, b = held.take(pa.array(order)), b[order]
    starts = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else []
    for lo, hi in zip(starts, [*starts[1:], len(b)], strict=True):
        yield int(b[lo]), held.slice(lo, hi - lo)


_ROW = "row_id long, fold int, x array<double>, b int, near array<struct<d:double,other:bigint,y:int>>"
#: Cells of the arrays that asking rows are tested against blocks in.
_TESTED = 2_000_000


def asked_blocks(own: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(row_id, fold, x, b, bound, part): the parts with another block that may hold one of a row's k nearest, after its own block's `near`."""
    names = ["row_id", "fold", "x", "b", "bound", "part"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, _TESTED // max(1, len(cells.table)))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                near = batch.column(batch.schema.get_field_index("near"))
                size = np.diff(near.offsets.to_numpy())
                d = near.flatten().field("d").to_numpy(zero_copy_only=False)
                last = np.cumsum(size) - 1
                bound = np.sqrt(np.where(size == k, d[np.maximum(last, 0)] if len(d) else 0.0, np.inf))
                nearest, _ = cells.reach(matrix(batch, "x"))
                hit = nearest <= bound[:, None]
                hit[np.arange(len(hit)), _get(batch, "b")] = False
                a, part = np.nonzero(cells.parts(hit))
                at = pa.array(a)
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).take(at) for c in names[:4]), pa.array(bound[a]), pa.array(part.astype(np.int32))], names)

    return own.mapInArrow(ask, "row_id long, fold int, x array<double>, b int, bound double, part int")


def nearest(rows: DataFrame, k: int, apart: bool, only: int | None = None) -> DataFrame:
    """(row_id, other, y, rank): the k nearest other rows of each (of each row of the fold `only`), by distance of `x`, then row_id.

    rows has (row_id, y, fold, x); with `apart`, rows of one's own fold don't count. A row meets its own block first; its k-th distance
    there bounds the others it meets. No task holds more than a part and a chunk of its askers.
    """
    dealt, cells = cells_of(rows)
    names = ["row_id", "fold", "x", "b"]

    def inside(t: pa.Table) -> pa.Table:
        asks = t if only is None else t.filter(pa.array(_get(t, "fold") == only))
        if not asks.num_rows:
            return asks.select(names).append_column("near", pa.array([], _NEAR))
        found = _compared(matrix(asks, "x"), _get(asks, "row_id"), _get(asks, "fold"), t, k, apart)
        return asks.select(names).append_column("near", found)

    def across(asks: pa.Table, held: pa.Table) -> pa.Table:
        parts: list[tuple[np.ndarray, ...]] = [(np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32))]
        ids = _get(asks, "row_id")
        if held.num_rows and asks.num_rows:
            x, fold, own, bound = matrix(asks, "x"), _get(asks, "fold"), _get(asks, "b"), _get(asks, "bound")
            for b, block in _by_block(held):
                near, _ = cells.reach(x, np.array([b]))
                m = np.flatnonzero((near[:, 0] <= bound) & (own != b))
                if len(m):
                    found = _compared(x[m], ids[m], fold[m], block, k, apart, (bound[m] * (1 + _SLACK)) ** 2)
                    at = np.repeat(m, np.diff(found.offsets.to_numpy()))
                    d, other, y = (found.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("d", "other", "y"))
                    keep = np.sqrt(d) <= bound[at] * (1 + _SLACK)
                    parts.append((at[keep], d[keep], other[keep], y[keep]))
        at, d, other, y = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((other, d, at))
        at, d, other, y = at[order], d[order], other[order], y[order]
        first = np.arange(len(at)) - np.searchsorted(at, at) < k
        at, d, other, y = at[first], d[first], other[first], y[first]
        rows, starts = np.unique(at, return_index=True)
        flat = pa.StructArray.from_arrays([pa.array(d), pa.array(other, pa.int64()), pa.array(y, pa.int32())], fields=list(_NEAR.value_type))
        near = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)), pa.int32()), flat).cast(_NEAR)
        return pa.table({"row_id": pa.array(ids[rows], pa.int64()), "near": near})

    own = stored(dealt.groupBy("b").applyInArrow(inside, _ROW), "neighbour-own")
    asks = stored(asked_blocks(own, cells, k), "neighbour-asks")
    asking, held = _spread(asks, dealt.select("row_id", "y", "fold", "x", "b"), cells.per)
    found = asking.groupBy("part", "chunk").cogroup(held.groupBy("part", "chunk")).applyInArrow(across, "row_id long, near array<struct<d:double,other:bigint,y:int>>")
    met = own.select("row_id", "near").unionByName(found).groupBy("row_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return met.select("row_id", F.posexplode("near").alias("at", "n")).select("row_id", "n.other", "n.y", (F.col("at") + 1).alias("rank"))


def _lists(t: pa.Table | pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, end to end, and how many each row has."""
    column = t.column(t.schema.get_field_index(name))
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten(), np.diff(column.offsets.to_numpy())


def _padded(flat: np.ndarray, sizes: np.ndarray, empty: float) -> np.ndarray:
    out = np.full((len(sizes), int(sizes.max(initial=0))), empty, flat.dtype)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def ranks_of(points: DataFrame, spots: DataFrame) -> DataFrame:
    """(row_id, other, rank): the place of `other` among all other rows by distance from row_id in `x`, then by id.

    points has (row_id, x), spots a row (row_id, others) for each row with a few others. Blocks that are wholly nearer than another are
    counted by their size, and those wholly farther not at all; only rows of blocks between are compared.
    """
    dealt, cells = cells_of(points.withColumn("y", F.lit(0)).withColumn("fold", F.lit(0)))
    dealt = dealt.select("row_id", "x", "b")
    pairs = spots.select("row_id", F.explode("others").alias("other")).join(dealt.select(F.col("row_id").alias("other"), F.col("x").alias("ox")), "other")
    pairs = pairs.groupBy("row_id").agg(F.collect_list(F.struct("other", "ox")).alias("to"))
    asks = dealt.join(pairs, "row_id").select("row_id", "x", "b", F.col("to.other").alias("others"), F.flatten("to.ox").alias("places"))
    names = ["row_id", "x", "b", "others", "limits", "closer", "part"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, _TESTED // max(1, len(cells.table)))
        part_of = np.arange(len(cells.table)) // cells.per
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows, step):
                batch = whole_batch.slice(lo, step)
                x, b, (_, size) = matrix(batch, "x"), _get(batch, "b"), _lists(batch, "others")
                places = _lists(batch, "places")[0].to_numpy(zero_copy_only=False).reshape(int(size.sum()), -1)
                flat = pair_squares(places, x[np.repeat(np.arange(len(x)), size)])
                limits = _padded(flat, size, -1.0)
                edge = np.where(limits >= 0, np.sqrt(np.maximum(limits, 0)), -1.0)
                near, far = cells.reach(x)
                between = np.zeros(near.shape, bool)
                for e in edge.T[:, :, None]:
                    between |= (near <= e) & (far >= e)
                open_ = cells.parts(between)
                shut = ~open_[:, part_of]
                row = np.arange(len(x))
                counted = np.zeros(limits.shape)
                for j, e in enumerate(edge.T[:, :, None]):
                    whole = (far < e) & shut
                    counted[:, j] = whole @ cells.table[:, 4] - whole[row, b]
                a, part = np.nonzero(open_)
                starts = pa.array(np.append(0, np.cumsum(size)), pa.int32())
                lists = pa.ListArray.from_arrays(starts, pa.array(flat))
                more = pa.ListArray.from_arrays(starts, pa.array(counted[limits >= 0].astype(np.int64)))
                mine = {c: batch.column(batch.schema.get_field_index(c)) for c in ("row_id", "x", "b", "others")} | {"limits": lists}
                yield pa.RecordBatch.from_arrays([mine["row_id"], pa.nulls(len(x), mine["x"].type), mine["b"], mine["others"], pa.nulls(len(x), lists.type), more, pa.array(np.full(len(x), -1, np.int32))], names)
                at = pa.array(a)
                yield pa.RecordBatch.from_arrays([*(mine[c].take(at) for c in names[:5]), pa.nulls(len(a), more.type), pa.array(part.astype(np.int32))], names)

    def count(asking: pa.Table, held: pa.Table) -> pa.Table:
        if not asking.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("row_id", "other", "closer")})
        x, ids, own = matrix(asking, "x"), _get(asking, "row_id"), _get(asking, "b")
        (others, size), (flat, _) = _lists(asking, "others"), _lists(asking, "limits")
        limits, to = _padded(flat.to_numpy(zero_copy_only=False), size, -1.0), _padded(others.to_numpy(zero_copy_only=False), size, -1)
        edge = np.where(limits >= 0, np.sqrt(np.maximum(limits, 0)), -1.0)
        closer = np.zeros(limits.shape, np.int64)
        for b, block in _by_block(held):
            hx, hid = matrix(block, "x"), _get(block, "row_id")
            near, far = cells.reach(x, np.array([b]))
            whole = far < edge
            closer += whole * (len(hid) - (own == b))[:, None]
            between = (near <= edge) & ~whole
            rows = np.flatnonzero(between.any(1))
            for lo in range(0, len(rows), 1024):
                m = rows[lo : lo + 1024]
                d, error = estimates(x[m], hx)
                mine = np.flatnonzero(own[m] == b)
                d[mine] = np.where(ids[m[mine], None] == hid, np.inf, d[mine])
                for j in np.flatnonzero(between[m].any(0)):
                    limit = limits[m, j][:, None]
                    sure = d < limit - error
                    o, at = np.nonzero((d <= limit + error) & ~sure)
                    exact = pair_squares(x[m[o]], hx[at])
                    nearer = (exact < limit[o, 0]) | ((exact == limit[o, 0]) & (hid[at] < to[m[o], j]))
                    closer[m, j] += (sure.sum(1) + np.bincount(o[nearer], minlength=len(m))) * between[m, j]
        return pa.table({"row_id": pa.array(np.repeat(ids, size), pa.int64()), "other": pa.array(to[limits >= 0], pa.int64()), "closer": pa.array(closer[limits >= 0], pa.int64())})

    sent = stored(asks.mapInArrow(ask, "row_id long, x array<double>, b int, others array<long>, limits array<double>, closer array<long>, part int"), "rank-sent")
    asking, held = _spread(sent.where("part >= 0").drop("closer"), dealt, cells.per)
    met = asking.groupBy("part", "chunk").cogroup(held.groupBy("part", "chunk")).applyInArrow(count, "row_id long, other long, closer long")
    counted = sent.where("part < 0").select("row_id", F.explode(F.arrays_zip("others", "closer")).alias("s")).select("row_id", F.col("s.others").alias("other"), "s.closer")
    return met.unionByName(counted).groupBy("row_id", "other").agg((F.sum("closer") + 1).alias("rank"))
