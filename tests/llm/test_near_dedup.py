import random

import numpy as np

from tillsight.llm import near_dedup


def brute(rows, percent=80):
    def shingles(t):
        t = (t or "").encode()
        w = bytes(b + 32 if 65 <= b <= 90 else b for b in t).split()
        return {(a, b) for a, b in zip(w, w[1:])} if len(w) > 1 else {tuple(w)} if w else set()
    ids = [d for d, _ in rows]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and None not in (ids[i], ids[j]) and (ids[i] == ids[j] or 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])):
                a, b = find(i), find(j)
                root[a] = b
    out = []
    for i in range(len(rows)):
        group = [ids[j] for j in range(len(rows)) if find(j) == find(i)]
        component = None if ids[i] is None else min(x for x in group if x is not None)
        out.append((ids[i], len(sets[i]), component, ids[i] is None or ids[i] == component))
    return out


def corpus(rng, n, edits):
    vocabulary = ["w%d" % i for i in range(400)]
    rows = []
    for g in range(n):
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 30, 120]))
        for _ in range(rng.randrange(1, 7)):
            t = list(base)
            for _ in range(rng.randrange(edits)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append(" ".join(t) if rng.random() < .8 else "  \n".join(t).upper())
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def compare(spark, rows, parts=4):
    df = spark.createDataFrame([(d, t, -1) for d, t in rows], "doc_id long, text string, component_id int").repartition(parts)
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_against_all_pairs(spark):
    compare(spark, corpus(random.Random(1), 60, 6))


def test_hot_group_of_chained_near_copies(spark):
    rng = random.Random(2)
    t = ["a%d" % i for i in range(60)]
    rows = []
    for i in range(80):  # each differs a little from the one before; far ends are not similar
        t[rng.randrange(60)] = "b%d" % i
        rows.append((i, " ".join(t)))
    compare(spark, rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "ONE"), (None, "one"), (6, "one two"), (7, "é Ü"), (8, "É ü"), (9, "x " * 4000), (10, "x x"), (4, "one")]
    compare(spark, rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(empty).count() == 0


def test_an_id_of_several_texts(spark):
    rng = random.Random(5)
    a, b, c = ([f"{x}{rng.randrange(900)}" for _ in range(60)] for x in "abc")
    near = lambda t: " ".join(t[:30] + ["other"] + t[31:])
    a2, b2 = near(a), near(b)
    a, b, c = map(" ".join, (a, b, c))
    rows = [(4, a), (4, b), (4, c), (5, a2), (3, b2), (6, c), (7, "x y z"), (7, "x y z"), (8, None), (8, ""), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()), key=str)
    assert out == sorted([(4, 4, True), (4, 3, False), (4, 4, True), (5, 4, False), (3, 3, True), (6, 4, False), (7, 7, True), (7, 7, True), (8, 8, True), (8, 8, True), (None, None, True)], key=str)
    kept = sorted((tuple(r) for r in near_dedup.distinct_rows(df).collect()), key=str)
    assert kept == sorted([(4, a), (4, c), (3, b2), (7, "x y z"), (8, None), (8, ""), (None, a)], key=str)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:240], rng.integers(0, 2**63, 60).astype(np.uint64)])
    one = a[:1]
    sets = [np.unique(x) for x in (a, b, one)]
    full = near_dedup.sketches(np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets]), 2000)
    assert (full != ~np.uint64(0)).all()
    assert abs((full[0] == full[1]).mean() - 240 / 360) < 0.05
