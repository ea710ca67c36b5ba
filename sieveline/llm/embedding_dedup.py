"""Near-duplicate embeddings through an inverted multi-index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sieveline.session import ship

from .common import block_of_np, column, save
from .components import components

#: Rows of the index and of queries that one group compares at most, and queries of one product.
STORED, ASKED, AT_ONCE = 8192, 16384, 512
#: Neighbouring cells are compared as one unit, of at least LEAST rows and of STORED in large tables.
LEAST, UNITS = 1024, 32
_PLACED = pa.schema([("unit", pa.int32()), ("block", pa.int32()), ("chunk", pa.int32()), ("home", pa.int32()), ("id", pa.int64()), ("m", pa.int64()), ("vec", pa.binary())])


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centroids of x by Lloyd's rounds from evenly spread rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _distances(x, c).argmin(1)
        for i in range(k):
            if (mine := near == i).any():
                c[i] = x[mine].mean(0)
    return c


class MultiIndex:
    """Independent codebooks on the two halves of unit vectors; a vector's cell is its pair of nearest centroids."""

    def __init__(self, sample: np.ndarray, k: int) -> None:
        self.half = sample.shape[1] // 2
        self.books = [codebook(x, k) for x in (sample[:, : self.half], sample[:, self.half :])]
        self.k = k

    def bounds(self, x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid of each row, and for each centroid the least squared distance from the row to its region.

        A region lies beyond the plane halfway to any other centroid, so the farthest such plane bounds the distance.
        """
        d = _distances(x, book)
        apart = np.sqrt(_distances(book, book))
        out = np.zeros_like(d)
        for a in range(len(book)):
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(apart[a] > 1e-12, (d - d[:, a : a + 1]) / (2 * apart[a]), 0)
            np.maximum(out, plane, out=out)
        return d.argmin(1), out**2

    def cells(self, x: np.ndarray) -> np.ndarray:
        one, two = (_distances(h, b).argmin(1) for h, b in zip((x[:, : self.half], x[:, self.half :]), self.books, strict=True))
        return one * self.k + two

    def reach(self, sample: np.ndarray, cosine: float, recall: float, least: int = 1000) -> float:
        """The sum of bounds up to which cells must be visited to find a share `recall` of the links.

        Measured on the links among the vectors of the sample, found by brute force. With a recall of 1, or fewer than `least`
        such links, it is the squared distance itself, beyond which no link can lie.
        """
        most = max(0.0, 2 - 2 * cosine) + 1e-9
        if recall >= 1 or self.k == 1:
            return most
        need = []
        at = [np.concatenate([_distances(h[lo : lo + 4096], b).argmin(1) for lo in range(0, len(h), 4096)]) for h, b in zip((sample[:, : self.half], sample[:, self.half :]), self.books, strict=True)]
        for lo in range(0, len(sample), 2048):
            x = sample[lo : lo + 2048]
            i, j = np.nonzero(x @ sample.T >= cosine)
            i, j = i[i + lo != j], j[i + lo != j]
            need.append(sum(self.bounds(h, b)[1][i, c[j]] for h, b, c in zip((x[:, : self.half], x[:, self.half :]), self.books, at, strict=True)))
        links = np.concatenate(need)
        return most if len(links) < least else min(most, float(np.quantile(links, recall, method="higher")) + 1e-9)

    def visits(self, x: np.ndarray, within: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell of each row, row, visited cell): the cells in ascending sum of both halves' bounds, up to `within`.

        Both halves' cells are sorted by bound; for each cell of the first, the traversal goes along the second as far as
        the sum allows.
        """
        one, lower1 = self.bounds(x[:, : self.half], self.books[0])
        two, lower2 = self.bounds(x[:, self.half :], self.books[1])
        by1, by2 = np.argsort(lower1, 1), np.argsort(lower2, 1)
        lower1, lower2 = np.take_along_axis(lower1, by1, 1), np.take_along_axis(lower2, by2, 1)
        rows, cells = [], []
        for r in range(self.k):
            left = within - lower1[:, r]
            if (left < 0).all():
                break
            i, j = np.nonzero(lower2 <= left[:, None])
            rows.append(i)
            cells.append(by1[i, r] * self.k + by2[i, j])
        return one * self.k + two, np.concatenate(rows), np.concatenate(cells)


def _packed(v: np.ndarray) -> list[bytes]:
    """Rows as bytes: of four-byte numbers where these hold them exactly."""
    with np.errstate(over="ignore"):
        short = v.astype("<f4")
    exact = (short == v).all(1)
    return [(short[i] if e else v[i]).tobytes() for i, e in enumerate(exact.tolist())]


def _unpacked(rows: list[bytes], width: int) -> np.ndarray:
    out = np.empty((len(rows), width))
    short = np.array([len(r) == 4 * width for r in rows], bool)
    for at, kind in ((np.flatnonzero(short), "<f4"), (np.flatnonzero(~short), "<f8")):
        if len(at):
            out[at] = np.frombuffer(b"".join([rows[i] for i in at.tolist()]), kind).reshape(len(at), width)
    return out


def _units(v: np.ndarray) -> np.ndarray:
    """Unit vectors."""
    u = v / np.abs(v).max(1)[:, None]  # so that squares neither overflow nor vanish
    return u / np.linalg.norm(u, axis=1)[:, None]


def _compare(cosine: float, width: int):
    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks().to_batches()[0]
        home, ids, m = (column(t, c).to_numpy() for c in ("home", "id", "m"))
        unit = column(t, "unit")[0].as_py()
        x = _units(_unpacked(column(t, "vec").to_pylist(), width))
        s, q = np.flatnonzero(home < 0), np.flatnonzero(home >= 0)
        found_q, found_s, near = np.zeros(len(q), np.int64), np.zeros(len(s), np.int64), []
        label_q, label_s, xs = ids[q].copy(), ids[s].copy(), np.ascontiguousarray(x[s].T)
        for lo in range(0, len(q) if len(s) else 0, AT_ONCE):
            own = q[lo : lo + AT_ONCE]
            close = x[own] @ xs >= cosine
            same = home[own] == unit
            close[same] &= ids[own][same, None] < ids[s][None, :]
            a, b = np.flatnonzero(close.any(1)), np.flatnonzero(close.any(0))
            if len(a):  # sums of copies; the links themselves as bits
                close = close[np.ix_(a, b)]
                found_q[lo + a], found_s[b] = close @ m[s[b]], found_s[b] + m[own[a]] @ close
                near.append((lo + a, b, np.packbits(close, 1)))
        # Ids of local components: the least id spreads over the links until nothing changes.
        top, moved = np.iinfo(np.int64).max, bool(near)
        while moved:
            moved = False
            for a, b, bits in near:
                links = np.unpackbits(bits, 1, len(b)).view(bool)
                new_q = np.minimum(label_q[a], np.where(links, label_s[b], top).min(1))
                new_s = np.minimum(label_s[b], np.where(links, new_q[:, None], top).min(0))
                moved |= bool((new_q < label_q[a]).any() or (new_s < label_s[b]).any())
                label_q[a], label_s[b] = new_q, new_s
        a, b = np.flatnonzero(found_q), np.flatnonzero(found_s)
        out = [np.concatenate((ids[q][a], ids[s][b])), np.concatenate((found_q[a], found_s[b])), np.concatenate((label_q[a], label_s[b]))]
        return pa.table({"id": pa.array(out[0], pa.int64()), "n": pa.array(out[1], pa.int64()), "root": pa.array(out[2], pa.int64())})

    return run


def _linked(classes: DataFrame, width: int, n: int, cosine: float, sample: int, per_cell: int, most_centroids: int, recall: float) -> DataFrame:
    """classes (v, id, m) of n different vectors of one width with n, the rows linked with each beside its own, and root."""
    spark = classes.sparkSession
    chosen = classes.orderBy(F.xxhash64("id")).select("v").limit(sample).collect()
    x = np.array([r["v"] for r in chosen])
    if width < 2:
        x = np.concatenate((x, np.zeros_like(x)), 1)
    x /= np.abs(x).max(1)[:, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = MultiIndex(x, int(min(most_centroids, len(x), max(1, round((n / per_cell) ** 0.5)))))
    shared = spark.sparkContext.broadcast(index)
    within = index.reach(x, cosine, recall)

    def vectors(batch: pa.RecordBatch) -> np.ndarray:
        v = column(batch, "v")
        return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)

    def halves(v: np.ndarray) -> np.ndarray:
        u = _units(v)
        return u if u.shape[1] > 1 else np.concatenate((u, np.zeros_like(u)), 1)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(shared.value.k ** 2, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                held += np.bincount(shared.value.cells(halves(vectors(batch.slice(lo, 4096)))), minlength=len(held))
        c = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(held[c])], ["cell", "n"])

    held = np.zeros(index.k**2, np.int64)
    for r in classes.mapInArrow(counted, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most most_centroids ** 2 rows
        held[r["cell"]] = r["n"]
    size = min(STORED, max(LEAST, n // UNITS))
    unit_of, filled = np.zeros(len(held), np.int32), 0
    for c in range(1, len(held)):  # cells in order, while they fit one unit
        filled += held[c - 1]
        new = filled > 0 and filled + held[c] > size
        unit_of[c], filled = unit_of[c - 1] + new, 0 if new else filled
    n_units = int(unit_of[-1]) + 1
    blocks = np.maximum(1, -(-np.bincount(unit_of, held, n_units).astype(np.int64) // STORED))
    of = spark.sparkContext.broadcast((unit_of, blocks))

    def asking(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit of each row, row, asked unit): each unit with a visited cell once, from the row's own unit on."""
        unit_of, blocks = of.value
        own, row, cell = shared.value.visits(halves(v), within)
        asked = np.zeros((len(v), len(blocks)), bool)
        asked[row, unit_of[cell]] = True
        own = unit_of[own]
        asked &= np.arange(len(blocks)) >= own[:, None]
        return own, *np.nonzero(asked)

    step = int(min(1024, max(8, 2_000_000 // index.k**2)))

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(of.value[1]), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                total += np.bincount(asking(vectors(batch.slice(lo, step)))[2], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["unit", "n"])

    chunks = np.ones(n_units, np.int64)
    for r in classes.mapInArrow(asks, "unit int, n long").groupBy("unit").agg(F.sum("n").alias("n")).collect():
        chunks[r["unit"]] = max(1, -(-r["n"] // ASKED))
    grid = spark.sparkContext.broadcast(chunks)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, chunks = of.value[1], grid.value
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                v = vectors(batch)
                ids, m = column(batch, "id").to_numpy(), column(batch, "m").to_numpy()
                own, row, unit = asking(v)
                at, turn = block_of_np(ids, 2**31 - 1) % blocks[own], block_of_np(ids * 7 + 3, 2**31 - 1)
                # Each is stored once for every chunk of its unit's visitors, and asks every block of the units it visits.
                sr = np.repeat(np.arange(len(ids)), chunks[own])
                sc = np.arange(len(sr)) - np.repeat(np.cumsum(chunks[own]) - chunks[own], chunks[own])
                qr = np.repeat(np.arange(len(row)), blocks[unit])
                qb = np.arange(len(qr)) - np.repeat(np.cumsum(blocks[unit]) - blocks[unit], blocks[unit])
                qrow, qunit = row[qr], unit[qr]
                all_rows = np.concatenate((sr, qrow))
                vec = pa.array(_packed(v), pa.binary())
                for i in range(0, len(all_rows), 20_000):
                    p = slice(i, i + 20_000)
                    r = all_rows[p]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate((own[sr], qunit))[p], pa.int32()), pa.array(np.concatenate((at[sr], qb))[p], pa.int32()), pa.array(np.concatenate((sc, turn[qrow] % chunks[qunit]))[p], pa.int32()),
                            pa.array(np.concatenate((np.full(len(sr), -1), own[qrow]))[p], pa.int32()), pa.array(ids[r]), pa.array(m[r]), vec.take(pa.array(r)),
                        ],
                        schema=_PLACED,
                    )

    found = classes.mapInArrow(placed, "unit int, block int, chunk int, home int, id long, m long, vec binary")
    found = save(found.groupBy("unit", "block", "chunk").applyInArrow(_compare(cosine, width), "id long, n long, root long"), "embedding-links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    comps = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("component_id", "root")
    return classes.join(counts, "id", "left").join(comps, "id", "left")


def near_embeddings(vectors: DataFrame, cosine: float = 0.95, sample: int = 16384, per_cell: int = 400, most_centroids: int = 512, recall: float = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id and kept.

    Vectors link if their cosine, in double precision, is at least `cosine`. n_links counts the other vectors linked directly,
    equal ones included; component_id is the smallest id reachable by links; kept marks the row with that id. Vectors that
    are null, empty or zero, hold null or non-finite components, or have a null id link with nothing (a null id gives a null
    component, kept). Vectors are compared with those of their length; every length of several different vectors takes passes of
    its own. Rows that repeat an id count as copies. Other columns, labels
    too, are ignored.

    Equal vectors are joined first. Codebooks are fitted on at most `sample` vectors, all vectors are indexed; the number of
    cells grows with the vectors, about one for `per_cell` of them, up to the square of `most_centroids`, which bounds what the
    driver holds (two numbers a cell). Each vector visits the nearest cells, in order, as far as a cell can hold a link. Neighbouring
    cells form units of up to STORED vectors; a vector is sent once to a unit of which it visits a cell. A `recall`
    below 1 stops where that share of the sample's links would be found (see MultiIndex.reach). Units are compared in blocks against chunks of their visitors, and a block gives sums and a
    forest, never its pairs.
    """
    spark = vectors.sparkSession
    ship(spark)
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.col("vec_id").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    d = d.withColumn("v", F.when(fine, F.col("v")))
    classes = save(d.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("m")), "vectors")
    sizes = {r["k"]: r["n"] for r in classes.groupBy(F.size("v").alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy("k").collect()}
    several = [k for k, n in sizes.items() if n > 1]
    alone = classes if not several else classes.where(~F.size("v").isin(several))
    known = alone.withColumns({"n": F.lit(None).cast("long"), "root": F.lit(None).cast("long")})
    for width in several:
        part = classes if len(sizes) == 1 else classes.where(F.size("v") == width)
        known = known.unionByName(_linked(part, width, sizes[width], cosine, sample, per_cell, most_centroids, recall))
    known = known.select("v", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    out = d.join(known, "v", "left")
    root = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.col("vec_id").eqNullSafe(root).alias("kept"))
