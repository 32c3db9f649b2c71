import os

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SF
from tillsight.llm import near_dedup, pii, quality_crf, toxicity, word_bpe
from tillsight.llm.labelled import remainder


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    kept = {r.doc_id: r for r in docs.collect()}

    def batch():
        rows = list(kept.values())
        return rows, pa.RecordBatch.from_pydict({"doc_id": [r.doc_id for r in rows], "text": [r.text for r in rows]})

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "safety", "distinct", "redacted", "packed"]
    for name, fit, scores, keep in (
        ("quality", lambda d: quality_crf.fit(d, labels, remainder(3) != 1), quality_crf.batch_scores, lambda s: s >= 0.5),
        ("safety", lambda d: toxicity.fit(d, labels, remainder(5) != 0), toxicity.batch_scores, lambda s: s < 0.5),
    ):
        fitted = fit(docs)
        rows, b = batch()
        use = keep(scores(b, fitted))
        out = stages[name](spark, docs, SF)
        assert out.columns == columns
        kept = {r.doc_id: r for r, k in zip(rows, use) if k}
        assert sorted(r.doc_id for r in out.collect()) == sorted(kept)
        docs = spark.createDataFrame(list(kept.values()), docs.schema)
    out = stages["distinct"](spark, docs, SF)
    # Word shingles of a stage are of five words.
    sets = {d: set(zip(*(w[i:] for i in range(5)))) or ({tuple(w)} if w else set()) for d, r in kept.items() for w in [r.text.lower().split()]}
    ids = sorted(sets)
    root = {d: d for d in ids}
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {d: new if x == old else x for d, x in root.items()}
    kept = {d: kept[d] for d in ids if root[d] == d}
    assert sorted(r.doc_id for r in out.collect()) == sorted(kept)
    docs = spark.createDataFrame(list(kept.values()), docs.schema)
    out = stages["redacted"](spark, docs, SF)
    model = pii.train(pii.labelled_rows())
    texts = {}
    for d, r in kept.items():
        raw = r.text.encode()
        _, spans = pii.find(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), model)[0]
        texts[d] = pii.redact(r.text, pii.line(spans))
    rows = out.collect()
    assert out.columns == columns and {r.doc_id: r.text for r in rows} == texts and all(r.n_chars == len(r.text) for r in rows)
    assert any("<email>" in t for t in texts.values())
    pieces = stages["packed"](spark, out, SF).collect()
    t = Tokenizer.from_file(public_tokenizers.path(word_bpe.VOCABULARY))
    total = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert total == {d: len(t.encode(x, add_special_tokens=False).ids) + 1 for d, x in texts.items()}


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, "", "en", "s", 0), (1, None, None, None, None), (2, "a b c", "en", "s", 5)]])
def test_odd_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == len(rows) and os.path.isdir(tmp_path)
    assert near_dedup.BROADCAST_IDS > 0


def test_workers_hold_one_model_and_small_batches(spark):
    from tillsight.llm import common

    name, made = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(name)
    try:
        for now, then in (("64MB", str(common.BATCH_BYTES)), ("9m", str(common.BATCH_BYTES)), ("100k", "100k"), ("5000b", "5000b")):
            spark.conf.set(name, now)
            common.small_batches(spark)
            assert spark.conf.get(name) == then
    finally:
        spark.conf.set(name, before)
    for key in ("a", "a", "b", "a"):
        assert common.held(key, lambda: made.append(key) or key) == key
    assert made == ["a", "b", "a"] and list(common._HELD) == ["a"]
