"""Regions of the search for two-dimensional neighbours, for features of few values."""

import numpy as np

from sieveline.operators import continuous as C


def _plane(x, y, many):
    slabs, rows = C._splits(x, y, many)
    return C._Plane(len(x), float(x.std()), float(y.std()), 0, slabs, rows, (C._Ranges.of(x, many), C._Ranges.of(y, many)))


def test_few_rows_of_a_feature_of_few_values_reach_other_regions():
    rng = np.random.default_rng(0)
    n = 40_000
    x = rng.integers(1, 4, n).astype(float)
    y = x * 30_000 + rng.random(n) * 20_000
    for a, b in ((x, y), (y, x)):
        p = _plane(a, b, 144)
        g = p.region(a, b, np.arange(n))
        assert p.box.shape[1] < 200
        rows = np.array([[f(v[g == r], initial=e) for f, v, e in ((np.min, a, np.inf), (np.max, a, -np.inf), (np.min, b, np.inf), (np.max, b, -np.inf))] for r in range(p.box.shape[1])]).T
        box = p.box[:, g]
        assert ((box[0] <= a) & (a <= box[1]) & (box[2] <= b) & (b <= box[3])).all()
        asked = np.concatenate([r for r, _ in p.others(rows, np.arange(n), a, b, np.full(n, 1.0), g)])
        assert len(np.unique(asked)) < n / 2  # every row did, and reached four


def test_chunks_of_askers_find_the_same_radii(spark):
    rng = np.random.default_rng(1)
    n = 3000
    x = rng.integers(1, 4, n).astype(float)
    y = (x * 30_000 + rng.random(n) * 20_000).round(0)
    cells = spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "f int, id long, x double, y double")
    found = {r.id: (r.rx, r.ry) for r in C.spread_radii(cells, 3, 100, {0: _plane(x, y, 36)}).collect()}
    rx, ry = C.pair_radii(x, y, 3)
    assert len(found) == n
    assert np.allclose([found[i] for i in range(n)], np.column_stack((rx, ry)), rtol=1e-12, atol=0)
