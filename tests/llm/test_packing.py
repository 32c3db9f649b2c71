import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tillsight.llm import packing, word_bpe

PATH = public_tokenizers.path(word_bpe.VOCABULARY)


@pytest.fixture(scope="module")
def theirs():
    t = Tokenizer.from_file(PATH)
    return t


def test_words_equal_the_library(theirs):
    rng = random.Random(3)
    ours = word_bpe.WordBPE(PATH)
    texts = ["", "a", " x  y\n\nz ", "Don't É é \x01 \x01 a\x01b <|endoftext|>", "A\x1cB c d 12 3.4", "ΑΣ ΑΣΑ İ ß", "q" * 3000]
    texts += ["".join(rng.choices("abcdeEÀéñß ÀΣσ中 \n\t.,'!0 ", k=rng.randrange(300))) for _ in range(300)]
    texts += ["x <|endoftext|> y", "a<|endoftext|>b <|startoftext|><|startoftext|>", "<|endoftext|", "<|EndOfText|>"]
    want = [theirs.encode(t, add_special_tokens=False).ids for t in texts]
    for t, ids in zip(texts, want):
        assert np.frombuffer(ours.encode(t), np.uint32).tolist() == ids, repr(t)
    for most in (1, 100, 1 << 20):
        got = {}
        for row, ids, offsets in ours.blocks(pa.array([*texts, None]), word_bpe.END, most):
            got.update((row + i, ids[a:b].tolist()) for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])))
        assert [got[i] for i in range(len(got))] == [[*ids, 1] for ids in [*want, []]]


def test_crc_join():
    a, b = b"hello ", b"world" * 100
    assert word_bpe.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert word_bpe.crc32_join(zlib.crc32(a), 0, 0) == zlib.crc32(a)


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_each_remainder_once(seed):
    rng = np.random.default_rng(seed)
    h = np.zeros(256, np.int64)
    np.add.at(h, np.clip(rng.lognormal(3.5, 1.0, 5000).astype(int), 1, 255), 1)
    h[77] += 9000 * (seed == 3)  # a hot length
    used = np.zeros_like(h)
    patterns = packing.plan(h, 256)
    for times, lengths in patterns:
        assert 0 < sum(lengths) <= 256
        for n in lengths:
            used[n] += times
    assert (used[1:] == h[1:]).all()
    filled = sum(t * sum(x) for t, x in patterns)
    assert filled >= (0.9 if seed == 3 else 0.97) * 256 * sum(t for t, _ in patterns) - 256


def test_rows(spark, theirs):
    rows = [(1, "one two three", 0), (2, None, 0), (3, "", 0), (1, "one two three", 0), (None, "x", 0), (9, "word " * 5000, 0)]
    rows += [(100 + i, "lorem ipsum dolor " * (i * 7 % 300), 0) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(5)
    out = [r.asDict() for r in packing.pack(df, PATH).collect()]
    for doc, text, _ in rows:
        ids = theirs.encode(text or "", add_special_tokens=False).ids + [1]
        mine = sorted((r for r in out if r["doc_id"] == doc), key=lambda r: r["start"])
        copies = sum(d == doc for d, _, _ in rows)
        assert sum(r["length"] for r in mine) == copies * len(ids)
        for r in mine:
            piece = np.array(ids[r["start"]:r["start"] + r["length"]], np.uint32).tobytes()
            assert r["ids_crc32"] == zlib.crc32(piece) and r["doc_tokens"] == len(ids)
    for s in {r["sequence_id"] for r in out}:
        at = 0
        for r in sorted((r for r in out if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.WINDOW
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_known_words_stay_few(theirs, monkeypatch):
    """More words than are kept: the table stays small, ids stay right."""
    monkeypatch.setattr(word_bpe, "KNOWN", 40)
    ours = word_bpe.WordBPE(PATH)
    rng = random.Random(8)
    for i in range(60):
        t = " ".join("".join(rng.choices("abcde", k=rng.randrange(1, 4))) for _ in range(30))
        assert np.frombuffer(ours.encode(t), np.uint32).tolist() == theirs.encode(t, add_special_tokens=False).ids
        assert len(ours.known) <= 40 + 30 and len(ours.flat) == ours.ends[-1]


def test_units_are_encoded_once(theirs):
    """A word's letters are encoded once, however they are capitalised and whatever signs follow."""
    ours = word_bpe.WordBPE(PATH)
    texts = ["esreing Esreing, ESREING... (esreing) esreing's", "Été ÉTÉ! été", "x_y __ a' 's 't !'s É́ é ≠ <|EndOfText|>"]
    texts += [" ".join(f"{chr(i)}a b{chr(i)} {chr(i)}, c{chr(i)}c;" for i in range(a, a + 48) if i != 0x0D) for a in range(33, 1200, 48)]
    for t in texts:
        assert np.frombuffer(ours.encode(t), np.uint32).tolist() == theirs.encode(t, add_special_tokens=False).ids, repr(t)
    known = ours.known.to_pylist()
    assert {"esreing", ",", "...", "été", "!"} <= set(known) and len(known) == len(set(known))
    assert not {"Esreing,", "ESREING...", "ÉTÉ!"} & set(known)
