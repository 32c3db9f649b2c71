import math

import numpy as np
from pyspark.sql import functions as F

from tillsight.llm import vector_search


def brute(rows, k, every):
    def usable(r):
        return r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])
    data = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, *_ in filter(usable, rows)]
    out = set()
    for q, v in data:
        if q % every:
            continue
        scores = {(-sum(a * b for a, b in zip(v, w)), i) for i, w in data if i != q and len(w) == len(v)}
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])}
    return out


def compare(spark, rows, k=10, every=10):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(4)
    got = [tuple(r) for r in vector_search.top_k(vector_search.integers(df), F.col("vec_id") % every == 0, k).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, k, every)


def test_random_clustered_and_tied(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "PAGE", 40)  # many pages and routing objects
    monkeypatch.setattr(vector_search, "LEAF", 8)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] * (1 + i % 3) + 0.05 * rng.normal(size=8)).tolist(), 0) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8, 0) for i in range(80)]  # one very common vector
    rows += [(2000 + i, [0.0] * 8, 0) for i in range(15)]
    compare(spark, rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 0), (10, [2.0, -1.0], 0), (1, [0.1, 0.1], 0), (2, None, 0), (3, [], 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0), (6, [None, 1.0], 0),
            (None, [1.0, 1.0], 0), (20, [1.0, 2.0, 3.0], 0), (21, [1.0, 0.0, 1.0], 0), (30, [5.0], 0), (0, [1.0, 2.0], 0)]
    compare(spark, rows)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_search.top_k(vector_search.integers(empty), F.lit(True)).count() == 0
