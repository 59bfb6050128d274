"""Centroid clustering against plain rounds over Python integers, and its bounds against exact distances."""

import hashlib
import math

import numpy as np
import pytest

from lexgraph.llm import centroids as C


def plain(rows, k, rounds, size, scale, seed):
    kept = [(i, tuple(math.floor(scale * float(x)) for x in v)) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: "~" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    cents = [list(x) for _, x in sorted(kept, key=lambda r: (digest(r[0]), np.array(r[1], "<i4").tobytes()))[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    near = lambda x: min((far(x, c), j) for j, c in enumerate(cents))[::-1]
    for _ in range(rounds):
        at = [near(x)[0] for _, x in kept]
        for j in range(len(cents)):
            mine = [x for (_, x), a in zip(kept, at, strict=True) if a == j]
            if mine:
                cents[j] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    last = [(i, *near(x)) for i, x in kept]
    each = {j: sum(d for _, c, d in last if c == j) for _, j, _ in last}
    shown = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return [(i, c, d, each[c], sum(each.values()), shown[c]) for i, c, d in last]


def key(r):
    return tuple((x is not None, x or 0) for x in r[:1]) + tuple(r[1:])


@pytest.mark.parametrize(("k", "rounds", "tracked"), [(4, 5, 3), (9, 4, 2), (2, 3, 1), (1, 2, 3), (60, 1, 3)])
def test_rounds(spark, k, rounds, tracked):
    rng = np.random.default_rng(k)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(40)]
    rows += [(100 + i, rows[3][1]) for i in range(20)] + [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1])]
    rows += [(200, None), (201, []), (202, [1.0] * 4), (203, [1.0, None, 1.0, 1.0, 1.0]), (204, [math.nan] * 5), (205, [math.inf] * 5), (206, [0.0] * 5)]
    df = spark.createDataFrame([(i, v, 7, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int, code int")
    got = C.digested(*C.cluster(df, k, rounds, 5, tracked=tracked)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows, k, rounds, 5, 1024, 3), key=key)


def test_empty(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert C.digested(*C.cluster(df, 8, 2, 64)).collect() == []
    assert C.digested(*C.cluster(df.where("false"), 8, 2, 64)).collect() == []


def test_components_beyond_the_limit(spark):
    df = spark.createDataFrame([(1, [1e6])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        C.cluster(df, 1, 1, 1)


@pytest.mark.parametrize("factor", [1, 1 << 22])
def test_bounds(factor):
    """Every assignment is the exact one, and most vectors of settled rounds need no scan."""
    rng = np.random.default_rng(7)
    x = (rng.integers(-20, 21, (600, 6)) + 60 * rng.integers(0, 5, (600, 1))).astype("<i4") * factor
    c = x[:9].astype(np.int64)
    b, scans = C.Bounds.fresh(x, 3), []
    for r in range(10):
        before, b.distance[:] = b.scanned, -1
        b.assign(c)
        exact = np.stack([C.paired(x, np.broadcast_to(q, x.shape)) for q in c], axis=1)
        assert (b.cluster == exact.argmin(axis=1)).all()
        assert (C.distances(x, c) == exact).all()
        assert (b.upper**2 >= exact.min(axis=1)).all()
        scans.append(b.scanned - before)
        moved = c.copy()
        for j in np.unique(b.cluster):
            mine = b.cluster == j
            moved[j] = [int(v) // int(mine.sum()) for v in x[mine].astype(object).sum(axis=0)]
        b.move(np.sqrt(C.paired(moved, c).astype(float)) * (1 + C.EPS))
        c = moved
        if r == 6:
            b.shrink(2)
    assert scans[0] == 600 and scans[-1] < 100
