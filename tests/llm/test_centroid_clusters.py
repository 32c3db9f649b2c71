import hashlib

import numpy as np

from tillsight.llm import centroid_clusters as cc


def brute(rows, k=8, rounds=10, dim=64):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        for c in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i, nearest(v), far(v, centroids[nearest(v)])) for i, v in kept), key=repr), centroids


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 5, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance string")


def same(spark, rows, **more):
    found = cc.cluster(frame(spark, rows), **more).collect()
    want, centroids = brute(rows, **more)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in found), key=repr) == want
    assert all(r.centroid == centroids[r.cluster] for r in found)
    return found


def test_against_plain_python(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 64))
    rows = [(i, (centres[i % 5] + 0.3 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(7, rows[3][1]), (7, rows[7][1]), (7, rows[7][1]), (None, rows[9][1])]
    rows += [(900, None), (901, []), (902, rows[0][1][:63]), (903, [None] + rows[0][1][1:]), (904, [float("nan")] + rows[0][1][1:]), (905, [float("inf")] * 64)]
    same(spark, rows)


def test_ties_few_rows_and_empty(spark):
    same(spark, [(i, [0.5] * 64) for i in range(40)])
    same(spark, [(1, [0.25] * 64), (2, [-0.25] * 64), (3, [0.0] * 64)])
    square = [(i, ([1.0, 1.0] if i % 4 == 0 else [1.0, -1.0] if i % 4 == 1 else [-1.0, 1.0] if i % 4 == 2 else [-1.0, -1.0])) for i in range(40)]
    same(spark, square, dim=2, k=3, rounds=3)
    assert cc.cluster(frame(spark, [(1, [1.0])])).count() == 0
    assert cc.with_inertia(cc.cluster(frame(spark, [(1, None)]))).count() == 0


def test_large_components_do_not_wrap(spark):
    rows = [(1, [1e30] * 64), (2, [-1e30] * 64), (3, [0.0] * 64)]
    out = {r.vec_id: r for r in cc.cluster(frame(spark, rows), k=2, rounds=1).collect()}
    assert len(out) == 3 and all(r.distance >= 0 for r in out.values())


def test_boxes_never_rule_out_the_nearest():
    rng = np.random.default_rng(2)
    for dim in (1, 2, 8):
        v = rng.integers(-6, 7, size=(200, 5, dim))
        centroids = rng.integers(-6, 7, size=(6, dim))
        alive = cc.candidates(v.min(axis=1), v.max(axis=1), centroids)
        for box, use in zip(v, alive):
            full, d = cc.assign(box, centroids, np.arange(6))
            part, e = cc.assign(box, centroids, np.flatnonzero(use))
            assert (full == part).all() and (d == e).all()


def test_hilbert_steps_are_neighbours():
    for dim, bits in ((2, 3), (3, 2), (8, 1)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dim, indexing="ij"), axis=-1).reshape(-1, dim)
        keys = cc.hilbert(grid, bits)
        order = np.lexsort(keys.T[::-1])
        walk = grid[order].astype(int)
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
        assert len({k.tobytes() for k in keys}) == len(grid)


def test_zone_maps_settle_whole_blocks(spark):
    """Separate groups: most blocks are settled without a look at their rows."""
    rng = np.random.default_rng(9)
    rows = [(i, (np.eye(64)[i % 8] * 20 + 0.01 * rng.normal(size=64)).tolist()) for i in range(8000)]
    seen = []
    cc.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), rounds=2, report=seen)
    assert len(seen) == 2 and seen[-1] > 0.4
