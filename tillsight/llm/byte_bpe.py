"""Byte-level BPE encoding and decoding by monoid tree reduction.

A piece (one match of the split pattern) is encoded by halves: the encodings
of two neighbouring byte strings are joined by re-encoding a window around
their boundary and widening it until the tokens outside it provably stay.
Halves of a few bytes are merged from scratch.

The proof is local.  A token sequence is the BPE encoding of its bytes if
and only if every two neighbouring tokens are what BPE makes of *their*
bytes.  Left tokens, window tokens and right tokens are encodings already,
so a join is final once the two pairs at the window's edges hold.  Decoding
concatenates token bytes up the same kind of tree: blocks of ids become
blocks of bytes, which are concatenated.

Texts are cut at spaces first (a cut before a single space is always a cut
between pieces), and the encodings of frequent words are kept in a bounded
cache of each Python worker.  Words of a block of texts are dictionary-encoded;
distinct ones that are not kept yet are split by the pattern together.

Defined results: NULL and empty texts have no ids; repeated rows are encoded
one by one; texts of any length are processed whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import Cache, documents

RANKS = "byte_bpe_multi_50k.tiktoken"
CACHED_WORDS = 250_000
#: Pieces of more bytes are encoded, but not kept.
CACHED_BYTES = 64
#: Pieces and halves of no more bytes are merged from scratch.
_LEAF = 4
_DECODE_IDS = 1 << 16
#: Bytes of text that are encoded together (a longer text is a block of its own).
BLOCK_BYTES = 1 << 20


class ByteBPE:
    """Encoder and decoder for one table of merge ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        by_id = sorted((i, b) for b, i in ranks.items())
        self.bytes_of = dict(by_id)
        n = by_id[-1][0] + 1 if by_id else 0
        self.blob, self.first = _table([self.bytes_of.get(i, b"") for i in range(n)])
        self.digits, self.digit_first = _table([b"%d," % i for i in range(n)])
        self.single = [ranks.get(bytes([b])) for b in range(256)]
        self.tie = [ranks.get(bytes((a, b)), 1 << 32) for a in range(256) for b in range(256)]
        # Encodings are kept as tuples: unlike lists, the collector does not walk them again and again.
        self.windows: dict[bytes, tuple[int, ...]] = {}
        self.sure: dict[int, bool] = {}  # by a << 32 | b
        self.parts = Cache(CACHED_WORDS)
        self.words = Cache(CACHED_WORDS)

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    # ---------------------------------------------------------------- encoding
    def merge(self, tokens: list[int]) -> tuple[int, ...]:
        """Merge neighbours by lowest rank, leftmost first, until none merges (for short windows)."""
        tokens, of, ranks = list(tokens), self.bytes_of, self.ranks
        found = [ranks.get(of[a] + of[b]) for a, b in zip(tokens, tokens[1:])]
        while True:
            best, at = None, -1
            for i, r in enumerate(found):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return tuple(tokens)
            tokens[at:at + 2] = [best]
            del found[at]
            if at < len(found):
                found[at] = ranks.get(of[best] + of[tokens[at + 1]])
            if at:
                found[at - 1] = ranks.get(of[tokens[at - 1]] + of[best])

    def window(self, data: bytes) -> tuple[int, ...]:
        """The encoding of a boundary window's bytes, from scratch."""
        if len(data) > CACHED_BYTES:
            return self._long_window(data)
        out = self.windows.get(data)
        if out is None:
            if len(self.windows) > CACHED_WORDS:
                self.windows.clear()
            out = self.windows[data] = self.merge([self.single[x] for x in data])
        return out

    def holds(self, a: int, b: int) -> bool:
        """Whether BPE makes just these two tokens of their bytes."""
        out = self.sure.get(a << 32 | b)
        if out is None:
            if len(self.sure) > CACHED_WORDS:
                self.sure.clear()
            out = self.sure[a << 32 | b] = self.window(self.bytes_of[a] + self.bytes_of[b]) == (a, b)
        return out

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of two encodings, one after the other."""
        if not left or not right:
            return left or right
        sure = self.sure.get(left[-1] << 32 | right[0])
        if sure or (sure is None and self.holds(left[-1], right[0])):
            return left + right
        i, j = len(left) - 1, 1
        window = self.window(self.bytes_of[left[-1]] + self.bytes_of[right[0]])
        while True:
            sure_left = i == 0 or self.holds(left[i - 1], window[0])
            sure_right = j == len(right) or self.holds(window[-1], right[j])
            if sure_left and sure_right:
                return left[:i] + window + right[j:]
            wider = max(1, len(left) - i)
            if not sure_left:
                i = max(0, i - wider)
            if not sure_right:
                j = min(len(right), j + max(1, j))
            window = self.window(b"".join([self.bytes_of[t] for t in left[i:] + right[:j]]))

    def _long_window(self, data: bytes) -> tuple[int, ...]:
        """A long window is merged by its own priority queue, so that a wide join stays n log n."""
        tokens = [self.single[x] for x in data]
        of, ranks, n = self.bytes_of, self.ranks, len(tokens)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, tokens[i], tokens[i + 1]) for i in range(n - 1) if (r := ranks.get(of[tokens[i]] + of[tokens[i + 1]])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if tokens[i] != a or j >= n or tokens[j] != b:
                continue
            tokens[i], tokens[j] = r, None
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y < n and (q := ranks.get(of[tokens[x]] + of[tokens[y]])) is not None:
                    heapq.heappush(heap, (q, x, tokens[x], tokens[y]))
        return tuple([t for t in tokens if t is not None])

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        """Encode one piece by halves."""
        if len(data) <= _LEAF:
            return self.windows.get(data) or self.window(data)
        out = self.parts.get(data)
        if out is None:
            half = self._cut(data) if len(data) <= CACHED_BYTES else len(data) // 2
            out = self.join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))
            if len(data) <= CACHED_BYTES:
                self.parts[data] = out
        return out

    def _cut(self, data: bytes) -> int:
        """Where to halve: in the middle third, between the two bytes that merge last, where a token most likely ends."""
        tie, n = self.tie, len(data)
        best, at = -1, 0
        for i in range(-(-n // 3), n - n // 3 + 1):
            r = tie[data[i - 1] << 8 | data[i]]
            if r > best:
                best, at = r, i
        return at

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.ranks.get(data)  # a piece in the table is that token, reachable by merges or not
        return (whole,) if whole is not None else self.encode_bytes(data)

    def _pieces(self, text: str) -> bytes:
        return array("I", [t for p in self.pattern.findall(text) for t in self.encode_piece(p)]).tobytes()

    def _add(self, words: list[str]) -> None:
        """Keep the encodings of words that each follow a space: just their first pieces start with one."""
        ids, begins = array("I"), []
        for p in self.pattern.findall(" " + " ".join(words)):
            if p[0] == " ":
                begins.append(4 * len(ids))
            ids.extend(self.encode_piece(p))
        raw = ids.tobytes()
        for w, begin, end in zip(words, begins, [*begins[1:], len(raw)], strict=True):
            self.words[w] = raw[begin:end]

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)``: the ids of all texts, one after the other, and where each text's begin and end."""
        self.parts.turn()
        self.words.turn()
        run = pc.match_substring_regex(texts, _RUN)
        # In other texts every space stands alone: each starts a piece, and no piece crosses it.
        lists = pc.split_pattern(pc.if_else(run, "", texts), " ")
        words, at = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        first = np.zeros(len(words), bool)
        first[at[:-1]] = True
        firsts = pc.if_else(run, texts, words.filter(pa.array(first))).to_pylist()
        coded = words.filter(pa.array(~first)).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        lacking = self.words.absent(distinct)
        if lacking:
            self._add(lacking)
        kept = [*map(self.words.__getitem__, distinct), *map(self._pieces, firsts)]
        n = np.fromiter(map(len, kept), np.int64, len(kept)) // 4
        flat, begin = np.frombuffer(b"".join(kept), np.uint32), np.cumsum(n) - n
        word = np.empty(len(words), np.int64)
        word[~first] = coded.indices.to_numpy(zero_copy_only=False)
        word[first] = len(distinct) + np.arange(len(firsts))
        n = n[word]
        stops = np.concatenate([[0], np.cumsum(n)])
        return flat[np.repeat(begin[word] - stops[:-1], n) + np.arange(stops[-1])], stops[at]

    def blocks(self, texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(first row, ids, offsets)`` of blocks of texts.  NULL is empty."""
        texts = pc.fill_null(texts.cast(pa.large_utf8()), "")
        sums = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        row = 0
        while row < len(texts):
            stop = max(row + 1, int(np.searchsorted(sums, (sums[row - 1] if row else 0) + most, "right")))
            yield row, *self._block(texts.slice(row, stop - row))
            row = stop

    def encoded(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text as uint32."""
        for _, ids, offsets in self.blocks(texts):
            for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                yield ids[begin:end]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text as uint32."""
        return self._block(pa.array([text], pa.large_utf8()))[0]

    # ---------------------------------------------------------------- decoding
    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids: blocks of ids are looked up together, blocks of bytes concatenated."""
        return b"".join(_lookup(self.blob, self.first, ids[i:i + _DECODE_IDS]) for i in range(0, len(ids), _DECODE_IDS))

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return b"".join(_lookup(self.digits, self.digit_first, ids[i:i + _DECODE_IDS]) for i in range(0, len(ids), _DECODE_IDS))[:-1]


#: White space next to a space: such a text is split by the pattern as a whole.
_RUN = r" [{0}]|[{0}] ".format(r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")


def _table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    first = np.zeros(len(entries) + 1, np.int64)
    np.cumsum([len(e) for e in entries], out=first[1:])
    return np.frombuffer(b"".join(entries), np.uint8), first


def _lookup(blob: np.ndarray, first: np.ndarray, ids: np.ndarray) -> bytes:
    """The entries of ``ids`` one after the other."""
    begin = first[ids]
    n = first[ids + np.uint32(1)] - begin
    ends = np.cumsum(n)
    at = np.arange(int(ends[-1]) if len(ends) else 0)
    return blob[at + np.repeat(begin - (ends - n), n)].tobytes()


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def encoder(path: str, pattern: str) -> ByteBPE:
    """The worker's encoder for a rank file (read once in each Python worker)."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBPE.load(path, pattern)
    return _LOADED[path, pattern]


def encode_documents(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` (little-endian uint32 bytes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([ids.tobytes() for ids in bpe.encoded(b.column(1))], pa.binary())], ["doc_id", "ids"])

    return documents(df).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, text_bytes`` of rows of ``doc_id, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for b in batches:
            out = [bpe.decode(np.frombuffer(x or b"", np.uint32)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "text_bytes"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, text_bytes binary")


def round_trip(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every row; ids stay within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for b in batches:
            n, of_ids, of_bytes = [], [], []
            for ids in bpe.encoded(b.column(1)):
                n.append(len(ids))
                of_ids.append(hashlib.sha256(bpe.decimal(ids)).hexdigest())
                of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes)],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(df).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: one row per document."""
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
