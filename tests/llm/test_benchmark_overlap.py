import random
import re

import pytest

from tillsight.llm import benchmark_overlap as bo

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans(bo.UPPER, bo.LOWER)


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items):
    wins = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), 10)
        for b in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[b:b + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, owners = set(), set()
        for n in range(1, 11):
            for b in range(len(w) - n + 1):
                own = wins.get(tuple(w[b:b + n]))
                if own is not None:
                    hit |= set(range(b, b + n))
                    owners |= own
        out.append((doc_id, len(w), len(hit), sorted(str(x) for x in owners if x is not None), bool(hit)))
    return sorted(out, key=repr)


def check(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, n_words int, key string").repartition(3)
    b = spark.createDataFrame([(i, t, "d") for i, t in items], "item_id long, text string, digest string")
    out = bo.overlaps(d, b, **more)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in out.collect()), key=repr)
    assert got == brute(docs, items)
    return got


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "中文", "🙂"]
    items = [(i, " ".join(rng.choices(vocabulary, k=k))) for i, k in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 14, 30, 60])]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for i in range(30)]
    for i in range(30):
        t = items[rng.randrange(len(items))][1].split()
        a = rng.randrange(len(t))
        piece = " , ".join(t[a:a + rng.randrange(1, 25)]).upper().lower()
        docs.append((100 + i, f"{docs[i][1]} {piece}. {docs[(i * 7) % 30][1]}"))
    return docs, items


@pytest.mark.parametrize("limit", [400_000, 0])  # broadcast, and salted
def test_against_all_windows(spark, limit):
    docs, items = corpus()
    docs += [(1, None), (None, items[12][1]), (None, ""), (5, items[13][1]), (5, items[13][1]), (6, "?!"), (7, " ".join([items[11][1]] * 40))]
    items += [(3, items[13][1]), (40, None), (41, "..."), (None, "only here and nowhere else but in one document said"), (12, items[12][1])]
    docs.append((77, "x Only here, and nowhere else; but in one document said y"))
    got = check(spark, docs, items, limit=limit)
    assert any(r[4] for r in got) and not all(r[4] for r in got)


def test_long_items_only_and_repetitive_words(spark):
    items = [(1, "a " * 25), (2, "a b " * 12), (10, "a a a a a a a a a b")]
    docs = [(i, "a " * i) for i in range(8, 14)] + [(50, "a " * 9 + "b"), (51, "b a " * 9), (52, "c " + "a b " * 5), (53, "a " * 3000)]
    check(spark, docs, items)


def test_a_passage_shared_by_many_documents(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    items = [(i, f"{passage} tail{i}") for i in range(50)]
    docs = [(i, f"own{i} {passage} end{i}") for i in range(400)] + [(1000 + i, f"clean {i}") for i in range(20)]
    got = check(spark, docs, items, limit=0)
    assert sum(r[4] for r in got) == 400


def test_empty_tables(spark):
    docs, items = corpus(2)
    check(spark, docs[:5], [])
    check(spark, [], items[:2])
    check(spark, docs[:3], [(1, None)])


def test_no_python_in_the_plan(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "b c d e f g h i j k")], "item_id long, text string")
    plan = bo.overlaps(d, b)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    prints = bo.documents(d).select(bo.fingerprints(bo.words(bo.F.col("text")), [10]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in prints and "Exchange" not in prints
