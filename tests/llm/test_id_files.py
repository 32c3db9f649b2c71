import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tillsight.llm import id_files, word_bpe

PATH = public_tokenizers.path(word_bpe.VOCABULARY)


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, 1000, n) for n in (1, 2, 700, 3000, 1500)]
    blocks += [np.zeros(2500, int), np.tile([5, 6, 7], 800), np.minimum(rng.zipf(1.3, 2500), 999), np.full(9, 999)]
    blocks = [b.astype(np.uint32) for b in blocks]
    words = id_files.encode_blocks(blocks, 1000)
    for w, b in zip(words, blocks):
        # A block alone decodes as well as in company.
        assert (id_files.decode_blocks([w], [len(b)], 1000)[0] == b).all()
    for x, b in zip(id_files.decode_blocks(words, [len(b) for b in blocks], 1000), blocks):
        assert (x == b).all()
    assert 4 * len(words[5]) < 2500 / 50 and 4 * len(words[6]) < 2400 / 20  # repeats cost next to nothing
    assert 4 * len(words[7]) < 2 * 2500  # skewed ids cost less than two bytes each


def test_damage_is_found():
    docs = np.array([(True, 7, 0, 3, 3)], id_files._DOC)
    data = id_files.body(docs, 3, id_files.encode_blocks([np.array([1, 2, 3])], 10)[0], 0, 0)
    assert id_files.parse(data)[0] == 3
    for i in (0, 10, len(data) // 2, len(data) - 1):
        bad = bytearray(data)
        bad[i] ^= 4
        with pytest.raises(ValueError):
            id_files.parse(bytes(bad))


def test_rows(spark):
    theirs = Tokenizer.from_file(PATH)
    rows = [(5, "one two three", 1), (2, None, 1), (3, "", 1), (5, "another text", 1), (5, "one two three", 1), (9, "a b c " * 900, 1), (1, "x", 1)]
    rows += [(20 + i, "lorem \" ipsum, dolor " * i, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5)
    files = id_files.write(df, PATH, block=512, lanes=4)
    out = sorted(id_files.summary(files, lanes=3).collect(), key=lambda r: r.start)
    at = 0
    for (doc, text, _), r in zip(sorted(rows, key=lambda r: (r[0], r[1] or "")), out, strict=True):
        ids = np.array(theirs.encode(text or "", add_special_tokens=False).ids + [1], np.uint32)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    pieces = id_files.read(files).orderBy("shard", "doc", "from_id").collect()
    assert sum(len(p.ids) // 4 for p in pieces) == at
    assert id_files.summary(id_files.write(df.limit(0), PATH)).count() == 0


def test_alphabets():
    rng = np.random.default_rng(3)
    for ids in ([], [0], [49_407], range(300), [0, 49_407], np.unique(rng.integers(0, 49_408, 9000)), np.unique(rng.zipf(1.4, 5000) % 49_408)):
        ids = np.array(ids, np.int64)
        words = id_files.pack_alphabet(ids)
        found, used = id_files.unpack_alphabet(np.concatenate([words, rng.integers(0, 1 << 32, 50).astype(np.uint32)]))
        assert (found == ids).all() and used == len(words)


def test_blocks_of_extreme_ids():
    rng = np.random.default_rng(4)
    blocks = [rng.permutation(49_408)[:id_files.MOST], np.zeros(id_files.MOST, int), np.array([49_407]), np.array([], int), rng.integers(49_000, 49_408, 8000),
              np.repeat(np.arange(900), 9), np.tile(np.arange(1300), 6), np.concatenate([np.zeros(4000, int), rng.integers(0, 5000, 4000)])]
    words = id_files.encode_blocks(blocks, 49_408)
    for x, b in zip(id_files.decode_blocks(words, [len(b) for b in blocks], 49_408), blocks, strict=True):
        assert (x == b).all()
    with pytest.raises(ValueError):
        id_files.encode_blocks([np.zeros(id_files.MOST + 1, int)], 49_408)
    with pytest.raises(ValueError):
        id_files.encode_blocks([np.array([49_408])], 49_408)


def test_rows_of_one_id_are_dealt_out(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).selectExpr("cast(if(id % 4 < 3, null, id) as long) as doc_id", "concat('the same ', cast(if(id % 2 = 0, 1, id) as string)) as text").repartition(5)
        files = id_files.write(df, PATH, block=256).cache()
        sizes = [r["n"] for r in files.groupBy("shard").sum("n_ids").withColumnRenamed("sum(n_ids)", "n").collect()]
        assert len(sizes) > 4 and max(sizes) < 2 * sum(sizes) / len(sizes)
        out = id_files.summary(files).orderBy("start").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r.doc_id for r in out] == [None] * 3000 + list(range(3, 4000, 4))
    assert all(b.start == a.start + a.n_tokens for a, b in zip(out, out[1:]))


def test_only_missed_indexes_are_searched(monkeypatch):
    """Indexes that a kept prediction gave are not looked up in the frequencies."""
    blocks = [np.tile([3, 1, 2], 500).astype(np.uint32) for _ in range(4)]
    words = id_files.encode_blocks(blocks, 10)
    looked, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *more: looked.append(np.size(v)) or search(a, v, *more))
    for x, b in zip(id_files.decode_blocks(words, [1500] * 4, 10), blocks, strict=True):
        assert (x == b).all()
    looked.remove(1500)  # blocks left at each step
    assert sum(looked) < 100


def test_frequencies_are_not_searched_across_blocks(monkeypatch):
    """Random indexes are found by their block's guide, not by a search over the frequencies of all blocks."""
    rng = np.random.default_rng(5)
    blocks = [rng.integers(0, 5000, 1500).astype(np.uint32) for _ in range(4)]
    words = id_files.encode_blocks(blocks, 5000)
    looked, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *more: looked.append(np.size(v)) or search(a, v, *more))
    for x, b in zip(id_files.decode_blocks(words, [1500] * 4, 5000), blocks, strict=True):
        assert (x == b).all()
    assert sum(looked) <= 1500  # blocks left at each step


def test_streams_of_a_block(monkeypatch):
    """A block takes one step per id of its longest stream, and the same words alone and in company."""
    rng = np.random.default_rng(6)
    sizes = [0, 1, 2, 1023, 1024, 1025, 2047, 2048, 2049, 5000, 8191, 8192, 8193, id_files.MOST - 1, id_files.MOST]
    blocks = [np.minimum(rng.zipf(1.2, n), 40_000).astype(np.uint32) for n in sizes]
    blocks += [np.tile(rng.integers(0, 49_408, 300), 20)[:n].astype(np.uint32) for n in sizes if n < 6000] + [np.full(8192, 7, np.uint32)]
    words = id_files.encode_blocks(blocks, 49_408)
    for w, b in zip(words, blocks, strict=True):
        assert (id_files.encode_blocks([b], 49_408)[0] == w).all()
        assert (id_files.decode_blocks([w], [len(b)], 49_408)[0] == b).all()
    steps, update = [], id_files._Model.update
    monkeypatch.setattr(id_files._Model, "update", lambda model, *more: steps.append(1) or update(model, *more))
    for x, b in zip(id_files.decode_blocks(words, [len(b) for b in blocks], 49_408), blocks, strict=True):
        assert (x == b).all()
    assert len(steps) <= 1024
