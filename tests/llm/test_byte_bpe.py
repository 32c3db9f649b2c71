import hashlib
import random
import re

import pytest
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

from tillsight.llm import byte_bpe

PATH = public_tokenizers.path(byte_bpe.RANKS)


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBPE.load(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def theirs(bpe):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


TEXTS = ["", " ", "a", "  a  b \n c\t\td ", "it's the end's \x1cx\x85y z", "naïve 北京 안녕 🙂🙂 é", "a" * 5000,
         "ab" * 3000 + "!" * 999, "x \n\n y", "1234567 89\r\n", "　 wide", "don't " * 50, "<|endoftext|>", "   q", "aaab" * 500]


def test_equals_the_library(bpe, theirs):
    rng = random.Random(5)
    alphabet = "abcdefgh eiou  \n\t'.,!0123ÀéñßЖ中文🙂‍́"
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randrange(1, 400))) for _ in range(400)]
    texts += ["".join(rng.choices("aehnrst", k=700)) for _ in range(20)]
    for t in texts:
        ids = bpe.encode(t)
        assert ids.tolist() == theirs.encode_ordinary(t), t[:80]
        assert bpe.decode(ids) == t.encode()


def test_tokens_encode_to_themselves_when_reachable(bpe):
    """The local proof needs byte tokens, and that joins equal a merge from scratch."""
    assert None not in bpe.single
    rng = random.Random(1)
    tokens = [b for b in bpe.ranks if len(b) > 3]
    for _ in range(300):
        a, b = rng.choice(tokens), rng.choice(tokens)
        assert bpe.join(bpe.encode_bytes(a), bpe.encode_bytes(b)) == bpe.merge([bpe.single[x] for x in a + b])


def test_rows(spark, theirs):
    rows = [(1, "one two", 7), (2, None, 7), (3, "", 7), (None, "null id", 7), (1, "one two", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = byte_bpe.round_trip(df, PATH, public_tokenizers.PATTERN).collect()
    assert len(out) == 5
    for (doc, text, _), r in zip(rows, out):
        ids = theirs.encode_ordinary(text or "")
        assert (r.doc_id, r.n_tokens) == (doc, len(ids))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    encoded = byte_bpe.encode_documents(df, PATH, public_tokenizers.PATTERN)
    back = byte_bpe.decode_documents(encoded, PATH, public_tokenizers.PATTERN).collect()
    assert [bytes(r.text_bytes).decode() for r in back] == [t or "" for _, t, _ in rows]
    assert byte_bpe.round_trip(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_blocks_equal_the_library(theirs):
    """Blocks of texts: distinct words that are not kept yet are split together, once."""
    ours = byte_bpe.ByteBPE.load(PATH, public_tokenizers.PATTERN)
    rng = random.Random(9)
    texts = TEXTS + ["ends \nx \x1c", "a\nb c\n", "b\u3000 c", "trail ", "\n\n a's b'll\n\nc d's", None]
    texts += ["".join(rng.choices("abcde  \n\t.,'!0\x1c\x85\xa0é中🙂", weights=[9] * 5 + [4] * 2 + [1] * 13, k=rng.randrange(1, 200))) for _ in range(400)]
    want = [theirs.encode_ordinary(t or "") for t in texts]
    for most in (1, 300, 1 << 20):
        got = {}
        for row, ids, offsets in ours.blocks(pa.array(texts), most):
            got.update((row + i, ids[a:b].tolist()) for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])))
        assert [got[i] for i in range(len(got))] == want
    calls = []
    ours.encode_piece, piece = lambda p: calls.append(p) or piece(p), ours.encode_piece
    assert len(list(ours.encoded(pa.array(["x Wordone wordtwo"] + ["y wordtwo Wordone"] * 50)))) == 51
    assert calls.count(" Wordone") == calls.count(" wordtwo") == 1


def test_runs_are_those_of_python():
    spaces = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and re.match(r"\s", chr(i))]
    other = ["\x1b", "\x84", "\u200b", "\u180e", "\ufeff", "a"]
    found = pc.match_substring_regex(pa.array([f"a{c} b" for c in spaces + other]), byte_bpe._RUN).to_pylist()
    assert found == [True] * len(spaces) + [False] * len(other)
