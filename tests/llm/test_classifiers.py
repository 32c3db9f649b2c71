import random
import zlib

import numpy as np

from tillsight.llm import quality_crf, toxicity

RNG = random.Random(8)
SYLLABLES = ("an", "re", "on", "ti", "ou", "ing", "er", "st", "ha", "nd")


def word():
    return "".join(RNG.choice(SYLLABLES) for _ in range(RNG.randrange(1, 5)))


def corpus(n=400):
    rows, labels = [], []
    for i in range(n):
        lines = [" ".join(word() for _ in range(RNG.randrange(5, 14))) + "." for _ in range(RNG.randrange(1, 7))]
        good, toxic = i % 5 != 0, i % 4 == 0
        if not good:
            lines = [" ".join(w.upper() + "!!" for w in x.split()) if i % 2 else " ".join(w + "###" for w in x.split()) for x in lines]
        if toxic:
            k = RNG.randrange(len(lines))
            lines[k] += " " + RNG.choice(("wretched", "vermin", "loathsome")) + " " + word()
        rows.append((i, "\n".join(lines), "x"))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def frames(spark):
    rows, labels = corpus()
    return (spark.createDataFrame(rows + [(1000, None, "x"), (1001, "", "x"), (None, "abc on", "x"), (3, rows[3][1], "x")], "doc_id long, text string, score string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels)


def check(spark, module, label, modulus, held):
    docs, labels, truth = frames(spark)
    out = module.classify(docs, labels).collect()
    assert len(out) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == held) for r in out)
    truth = {d: (q, t)[label] for d, q, t in truth}
    judged = [r for r in out if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in judged]) > 0.95
    # Labels of held-out rows never reach a score.
    turned = labels.selectExpr("doc_id", f"IF(crc32(CAST(doc_id AS STRING)) % {modulus} = {held}, 1 - quality, quality) AS quality",
                               f"IF(crc32(CAST(doc_id AS STRING)) % {modulus} = {held}, 1 - toxic, toxic) AS toxic")
    again = module.classify(docs, turned).collect()
    assert sorted((str(r.doc_id), r.score) for r in again) == sorted((str(r.doc_id), r.score) for r in out)
    none = module.classify(docs, labels.limit(0)).collect()
    assert len(none) == len(out)
    assert module.classify(docs.limit(0), labels).count() == 0


def test_quality(spark):
    check(spark, quality_crf, 0, 3, 1)


def test_toxicity(spark):
    check(spark, toxicity, 1, 5, 0)


def test_toxic_word_of_few_documents(spark):
    # Only five labelled training documents hold the word.
    docs, labels, _ = frames(spark)
    is_held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    ids = [d for d in range(2000, 2200)]
    train, held = [d for d in ids if not is_held(d)][:5], [d for d in ids if is_held(d)][:6]
    rng = random.Random(3)
    text = lambda d: " ".join("".join(rng.choice(("ja", "mu", "ke", "lo", "vi")) for _ in range(3)) for _ in range(20)) + (" quvaxil" if d in train + held[:3] else "")
    clean = [d for d in ids if d not in train + held and not is_held(d)][:40]
    docs = docs.unionByName(spark.createDataFrame([(d, text(d), "x") for d in train + held + clean], docs.schema))
    labels = labels.unionByName(spark.createDataFrame([(d, 1, int(d in train)) for d in train + clean], labels.schema))
    out = {r.doc_id: r.predicted for r in toxicity.classify(docs, labels).collect()}
    assert [out[d] for d in held] == [1, 1, 1, 0, 0, 0]
    assert all(out[d] == 1 for d in train) and not any(out[d] for d in clean)


def test_line_features_of_plain_lines():
    texts = ["a b\n\nC D!! #", "", "x x x\nx x x"]
    raw = [t.encode() for t in texts]
    x, size, first = quality_crf.line_features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(t) for t in raw]))
    assert first.tolist() == [0, 3, 4, 6]
    assert size.tolist() == [len(y.encode()) for t in texts for y in t.split("\n")]
    assert x[:, 13].tolist() == [0, 1, 0, 1, 0, 0]  # lines without words
    assert x[:, 11].tolist() == [0, 0, 0, 0, 0, 1]  # a repeated line of the same text
    assert np.allclose(x[4:, 9], 2 / 3)  # repeated words


def test_sample_is_bounded(spark):
    from pyspark.sql import functions as F
    from tillsight.llm import labelled, quality_crf

    docs = spark.range(3000).select((F.col("id") % 6).alias("doc_id"), F.concat(F.lit("a line\n"), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)] * 3, "doc_id long, quality int")
    found = labelled.sample(docs, labels, "quality", F.lit(True), 4).collect()
    assert len(found) == 4 == len({r.doc_id for r in found}) and all(r.label == r.doc_id % 2 for r in found)
    # A text of very many lines trains with its first lines only and is scored whole.
    long = spark.createDataFrame([(0, "bad #### line\n" * 9000), (1, "a good line of words\n" * 3), (2, None)], "doc_id long, text string")
    model = quality_crf.fit(long, labels, F.lit(True))
    scores = {r.doc_id: r.score for r in quality_crf.score(long, model).collect()}
    assert set(scores) == {0, 1, 2} and scores[0] < 0.5 < scores[1]
