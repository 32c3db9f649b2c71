"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A block stores its own alphabet (the distinct ids, their gaps in Rice codes)
and codes indexes into it.  Three predictions stand for the next index: the
one kept for the same two ids before it (order 2), for the same id (order 1),
and the adaptive frequencies of the block so far (order 0).  Orders 1 and 2
keep a confidence, raised by a hit and lowered by a miss, which decides when
an index is replaced.  The mixture's weights are adaptive counts of which
prediction was right, kept for each pair of confidences; the mixture drives a
range coder.  Kept predictions change with every id; frequencies and weights
take in the ids since the last count after 4, 8, ..., 64 ids of a stream, then
whenever it has grown by a third.  A block starts from an empty model, so any
block is decoded alone, and ends with a crc32 of all its bytes.

The ids of a block are cut into streams of at most ``STREAM`` ids, each with a
range of its own, which share the block's model: at step t every stream codes
its id number t (where two streams keep a prediction in one place, the later
stream's stays).  Blocks of a task are coded side by side: one numpy step codes
the next id of every stream of every block, and the encoder, which knows what
comes, works out the parts of many steps together.  Ranges are whole numbers
below 2^48 in doubles, whose quotients of parts are exact when rounded down.

A file is a Parquet file whose rows are blocks, in order; a row's ``body`` is
a complete block (header, document table, code words, crc32).  Spark's own
writer commits the files, in any store that Spark can write.

Defined results: a NULL or empty text has the end id alone; rows of equal
``doc_id`` stand next to each other, ordered by the first ``PREFIX`` characters
of their texts (files are ranges of both, and equal rows may be in several);
a NULL ``doc_id`` comes first; an empty table gives no rows.  A damaged block
raises an error.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import word_bpe
from .common import documents, stored

#: Ids in a block.
BLOCK = 8_192
#: A coded index has 14 bits, so a block cannot have more ids.
MOST = 1 << 14
#: Ids in a stream of a block, at most.
STREAM = 1_024
#: Blocks coded side by side; bounds a task's memory (about 0.1 MB each).
LANES = 1_024
#: Contexts of order 2 that a block keeps, as a power of two.
_TWO = 13
PREFIX = 256
_MAGIC = b"TIDB3"
_HEAD = struct.Struct("<5sIIIQQ")
_DOC = np.dtype([("has_id", "u1"), ("doc_id", "<i8"), ("from", "<i8"), ("n", "<i8"), ("of", "<i8")])
#: A range lies in [2^24, 2^48], so whole numbers of it are exact as doubles; it has 2^20 parts.
_WORD, _WINDOW, _PARTS = float(1 << 24), float(1 << 48), float(1 << 20)
#: A kept prediction: 14 bits of index, 2 bits of confidence (0: none yet).
_ONE, _BITS, _THREE = np.uint16(1), np.uint16(2), np.uint16(3)
#: Factors for the last id and the one before it, and the shift that leaves ``_TWO`` bits.
_HASH = np.uint16(31337), np.uint16(40503), np.uint16(16 - _TWO)
_CLASSES = 32
#: Order-0 frequencies in a slot of the guide that finds their index; the halves of a slot.
_SLOT, _HALVES = 16, (8, 4, 2, 1)
#: Ids whose parts an encoder works out together.
_TOGETHER = 1 << 16
#: What a sighting weighs against 1 for an id of the alphabet not seen yet.
_STEP = 2


class _Model:
    """The predictions of blocks side by side: of every stream's next id, from its block's ids so far.

    ``sizes`` are those of the blocks' alphabets, ``block`` has the block of each stream.
    """

    def __init__(self, sizes: np.ndarray, block: np.ndarray, longest: int, guided: bool):
        blocks, self.most, self.guided = len(sizes), int(sizes.max()), guided
        self.block, self.number = block, np.arange(blocks)
        self.seen = np.zeros((longest, len(block)), np.uint16)
        # One table for both orders: contexts of order 2 of every block, then those of order 1.
        self.kept = np.zeros((blocks << _TWO) + blocks * self.most, np.uint16)
        self.two_at, self.one_at = block << _TWO, (blocks << _TWO) + block * self.most
        self.last, self.older = np.zeros((2, len(block)), np.uint16)
        # How often orders 0, 1 and 2 were right, by (same index, confidence of 2, of 1); 0 where there is nothing to take.
        same, f2, f1 = np.meshgrid([0, 1], range(4), range(4), indexing="ij")
        start = np.stack([np.ones_like(f1), (f1 > 0) & ~((same > 0) & (f2 > 0)), f2 > 0]).reshape(3, _CLASSES).astype(np.int64)
        self.right, self.class_at = np.tile(start, (blocks, 1, 1)), block * _CLASSES
        # The order that was right and the class, of the ids since the last count.
        self.log = np.zeros((max(64, longest // 2), len(block)), np.uint8)
        # Order-0 frequencies: 1 for an id of the alphabet, and a step for each sighting.  Rows of ``cum`` end in room to search.
        self.often = (np.arange(self.most) < sizes[:, None]).astype(np.uint16)
        self.cum = np.full((blocks, self.most + 1 + _SLOT), 0xFFFF, np.uint16)
        self.flat, self.cum_at = self.cum.reshape(-1), block * self.cum.shape[1]
        self.counted = 0

    def count(self, t: int) -> int:
        """Take the streams' ids up to number ``t`` into frequencies and weights; the number of the id to do so again."""
        if t:
            at = np.ascontiguousarray(self.seen[self.counted:t].T) + (self.block * self.most)[:, None]
            self.often += (np.bincount(at.ravel(), minlength=self.often.size) * _STEP).astype(np.uint16).reshape(self.often.shape)
            at = np.ascontiguousarray(self.log[:t - self.counted].T) + (self.block * (3 * _CLASSES))[:, None]
            self.right += np.bincount(at.ravel(), minlength=self.right.size).reshape(self.right.shape)
            large = (self.right.sum(axis=1) > 700)[:, None]
            self.right = (self.right + large) >> large
        self.cum[:, 0] = 0
        np.cumsum(self.often, axis=1, out=self.cum[:, 1:self.most + 1], dtype=np.uint16)
        total = self.cum[:, self.most].astype(np.int64)
        self.total = total[self.block].astype(np.float64)
        if self.guided:
            slots = -(-int(total.max()) // _SLOT) + 1
            first = ((self.cum[:, :self.most] + np.uint16(_SLOT - 1)) // np.uint16(_SLOT)) + (self.number * slots)[:, None]
            starts = np.bincount(first.ravel(), minlength=slots * len(total)).astype(np.uint16).reshape(-1, slots)
            self.guide, self.guide_at = starts.cumsum(axis=1, dtype=np.uint16).ravel(), self.block * slots
        # Order 0 has at least a part for each unit of its frequencies.
        part = (_PARTS - total)[:, None] / self.right.sum(axis=1)
        w1, w2 = np.floor(part * self.right[:, 1]), np.floor(part * self.right[:, 2])
        self.end1 = (_PARTS - w2).ravel()
        self.end0 = self.end1 - w1.ravel()
        self.counted = t
        return t + t // 3 if t >= 64 else 2 * t if t else 4

    def contexts(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the first ``m`` streams' predictions of their next id are kept, and these: order 2, then order 1."""
        last = self.last[:m]
        at = np.empty((2, m), np.int64)
        np.add((last * _HASH[0] + self.older[:m]) >> _HASH[2], self.two_at[:m], out=at[0])
        np.add(last, self.one_at[:m], out=at[1])
        np.multiply(last, _HASH[1], out=self.older[:m])
        return at, self.kept.take(at)

    def update(self, m: int, x: np.ndarray, at: np.ndarray, found: np.ndarray, index: np.ndarray, sure: np.ndarray) -> None:
        right = index == x
        step = right.astype(np.uint16)
        step += step
        step -= _ONE
        step += found
        # One more after a hit, at most 3; one less after a miss; where nothing is left, the index that came.
        kept = np.minimum(step, found | _THREE)
        right |= sure > _ONE
        other = (x << _BITS) | _ONE
        kept ^= other
        kept *= right
        kept ^= other
        self.kept[at] = kept
        self.last[:m] = x


def _classes(index2: np.ndarray, index1: np.ndarray, sure2: np.ndarray, sure1: np.ndarray) -> np.ndarray:
    """Classes of pairs of predictions, for the weights."""
    return (index2 == index1) * np.uint16(16) + (sure2 * np.uint16(4) + sure1)


class _Streams:
    """The streams of blocks of the given sizes, longest first; ``begin`` and ``end`` are their ids in the block."""

    def __init__(self, sizes: list[int]):
        n = np.array(sizes)
        self.of = np.maximum(1, -(-n // STREAM))  # streams of each block
        block = np.repeat(np.arange(len(n)), self.of)
        number = np.arange(len(block)) - np.repeat(np.cumsum(self.of) - self.of, self.of)
        length = -(-n // self.of)[block]
        begin = np.minimum(number * length, n[block])
        end = np.minimum(begin + length, n[block])
        self.order = np.argsort(begin - end, kind="stable")  # of streams in the order of blocks
        self.block, self.begin, self.end = block[self.order], begin[self.order], end[self.order]
        self.longest = int((end - begin).max())
        #: How many streams have an id number 0, 1, ..., up to the ids of the largest block (none beyond the longest stream).
        self.left = np.searchsorted(self.begin - self.end, -np.arange(int(n.max())), "left")


def pack_alphabet(ids: np.ndarray) -> np.ndarray:
    """Words (uint32) of ascending distinct ids: their number and the Rice parameter, then the gaps' unary and low parts."""
    n = len(ids)
    if not n:
        return np.zeros(1, "<u4")
    ids = ids.astype(np.int32)
    gaps = ids.copy()
    gaps[1:] -= ids[:-1] + np.int32(1)
    k = max(0, math.ceil(math.log2((int(ids[-1]) + 1 - n) / n * 0.7 + 1e-9)))
    ends = np.cumsum((gaps >> k) + 1)
    unary = int(ends[-1])
    bits = np.ones(unary + n * k, np.uint8)
    bits[ends - 1] = 0
    np.bitwise_and(gaps[:, None] >> np.arange(k, dtype=np.int32), 1, out=bits[unary:].reshape(n, k), casting="unsafe")
    packed = np.packbits(bits).tobytes()
    return np.frombuffer(struct.pack("<I", n | k << 24) + packed + bytes(-len(packed) % 4), "<u4")


def unpack_alphabet(words: np.ndarray) -> tuple[np.ndarray, int]:
    """The ids that ``pack_alphabet`` wrote, and how many words they took."""
    n, k = int(words[0]) & 0xFFFFFF, int(words[0]) >> 24
    if not n:
        return np.zeros(0, np.int64), 1
    # The unary part has n zeros and, by the choice of k, less than 2 n ones.
    bits = np.unpackbits(np.ascontiguousarray(words[1:2 + -(-n * (k + 3) // 32)], "<u4").view(np.uint8))
    ends = np.flatnonzero(bits == 0)[:n]
    at = int(ends[-1]) + 1
    low = np.zeros(n, np.int64)
    for j in range(k):
        low += bits[at + j:at + n * k:k].astype(np.int64) << j
    # The ones before the zeros sum up to the ids' upper parts.
    return ((ends - np.arange(n)) << k) + np.cumsum(low) + np.arange(n), 1 + -(-(at + n * k) // 32)


def _bytes(words: np.ndarray) -> np.ndarray:
    """Settled words of 24 bits as uint32 words."""
    raw = np.ascontiguousarray(words, "<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return np.frombuffer(raw + bytes(-len(raw) % 4), "<u4")


def _words(data: np.ndarray) -> np.ndarray:
    """The words of 24 bits that ``_bytes`` wrote, and perhaps one of padding."""
    raw = np.ascontiguousarray(data, "<u4").view(np.uint8)
    return np.pad(raw[:len(raw) // 3 * 3].reshape(-1, 3), ((0, 0), (0, 1))).view("<u4").ravel()


def encode_blocks(blocks: list[np.ndarray], symbols: int) -> list[np.ndarray]:
    """Code words (uint32) of each block of ids below ``symbols``: its alphabet, its streams' lengths, its indexes."""
    if any(len(b) > MOST for b in blocks):
        raise ValueError(f"a block holds at most {MOST} ids")
    if not blocks:
        return []
    streams, alphabets, indexes = _Streams([len(b) for b in blocks]), [], []
    present, rank = np.zeros(symbols, bool), np.zeros(symbols, np.uint16)
    for ids in blocks:
        if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < symbols:
            raise ValueError(f"ids must lie in [0, {symbols})")
        present[ids] = True
        found = np.flatnonzero(present)
        present[found] = False
        rank[found] = np.arange(len(found))
        alphabets.append(found)
        indexes.append(rank[ids.astype(np.int64)])
    rows = np.zeros((len(streams.block), streams.longest), np.uint16)
    for row, (i, begin, end) in enumerate(zip(streams.block.tolist(), streams.begin.tolist(), streams.end.tolist())):
        rows[row, :end - begin] = indexes[i][begin:end]
    model = _Model(np.maximum(1, [len(a) for a in alphabets]), streams.block, streams.longest, False)
    model.seen = columns = np.ascontiguousarray(rows.T)
    del rows, indexes
    low, width = np.zeros(len(streams.block)), np.full(len(streams.block), _WINDOW)
    # An id settles at most one word.
    out, used = np.zeros((len(low), streams.longest + 2), np.uint32), np.zeros(len(low), np.int64)
    flat, out_at = out.reshape(-1), np.arange(len(low)) * out.shape[1]
    t = recount = 0
    while t < streams.longest:
        if t == recount:
            recount = model.count(t)
        m = int(streams.left[t])
        stop = min(recount, t + max(1, _TOGETHER // m), streams.longest)
        stop = t + int((streams.left[t:stop] == m).sum())
        # The kept predictions of some steps, one step after the other ...
        founds, xs = np.empty((stop - t, 2, m), np.uint16), columns[t:stop, :m]
        for x, found in zip(xs, founds):
            at, found[:] = model.contexts(m)
            model.update(m, x, at, found, found >> _BITS, found & _THREE)
        # ... then the parts of all these steps together ...
        index, sure = founds >> _BITS, founds & _THREE
        is2, is1 = ((index == xs[:, None]) & (sure > 0)).transpose(1, 0, 2)
        is1 = is1 & ~is2
        key = _classes(index[:, 0], index[:, 1], sure[:, 0], sure[:, 1])
        model.log[t - model.counted:stop - model.counted, :m] = key + (is2 * np.uint8(2 * _CLASSES) + is1 * np.uint8(_CLASSES))
        key = key + model.class_at[:m]
        end0, end1 = model.end0.take(key), model.end1.take(key)
        at, total = model.cum_at[:m] + xs, model.total[:m]
        begin, end = np.floor(model.flat.take(at) * end0 / total), np.floor(model.flat.take(at + 1) * end0 / total)
        begin = np.where(is2, end1, np.where(is1, end0, begin))
        size = np.where(is2, _PARTS, np.where(is1, end1, end)) - begin
        # ... then the ranges.
        low_m, width_m = low[:m], width[:m]
        for b, s in zip(begin, size):
            unit = np.floor(width_m * (1 / _PARTS))
            low_m += b * unit
            np.multiply(s, unit, out=width_m)
            full = np.flatnonzero(width_m < _WORD)
            lows, n = low_m.take(full), used.take(full)
            word = np.floor(lows * (1 / _WORD))
            flat[out_at.take(full) + n] = word
            used[full] = n + 1
            low_m[full] = (lows - word * _WORD) * _WORD
            width_m[full] = width_m.take(full) * _WORD
        t = stop
    for _ in range(2):
        word = np.floor(low * (1 / _WORD))
        flat[out_at + used] = word
        used += 1
        low = (low - word * _WORD) * _WORD
    # A word above 24 bits carries into the one before it.
    rows, at = np.nonzero(out[:, :int(used.max())] >> 24)
    over = out_at[rows] + at
    while len(over):
        flat[over] &= 0xFFFFFF
        flat[over - 1] += np.uint32(1)
        over = over[flat[over - 1] >> 24 > 0] - 1
    at = np.empty(len(low), np.int64)
    at[streams.order] = np.arange(len(low))  # rows of the streams in the order of blocks
    result, row = [], 0
    for alphabet, n in zip(alphabets, streams.of.tolist()):
        some = at[row:row + n]
        lengths = np.zeros(n // 2 * 2, "<u2")
        lengths[:n - 1] = used[some[:-1]]
        result.append(np.concatenate([pack_alphabet(alphabet), lengths.view("<u4"), _bytes(np.concatenate([out[r, :used[r]] for r in some]))]))
        row += n
    return result


def decode_blocks(words: list[np.ndarray], sizes: list[int], symbols: int) -> list[np.ndarray]:
    """The ids of blocks, from their code words and numbers of ids."""
    if not words:
        return []
    streams, alphabets, data, starts, size = _Streams(sizes), [], [], [], 0
    for block, n in zip(words, streams.of.tolist()):
        found, at = unpack_alphabet(block)
        if len(found) and int(found[-1]) >= symbols:
            raise ValueError(f"ids must lie in [0, {symbols})")
        alphabets.append(found)
        lengths = np.ascontiguousarray(block[at:at + n // 2], "<u4").view("<u2")[:n - 1]
        data.append(_words(block[at + n // 2:]))
        starts.append(size + np.cumsum(np.concatenate([[0], lengths.astype(np.int64)])))
        size += len(data[-1])
    flat, word_at = np.concatenate(data), np.concatenate(starts)[streams.order] + 2
    del data
    model = _Model(np.maximum(1, [len(a) for a in alphabets]), streams.block, streams.longest, True)
    code, width = flat[word_at - 2] * _WORD + flat[word_at - 1], np.full(len(word_at), _WINDOW)
    recount = 0
    for t in range(streams.longest):
        if t == recount:
            recount = model.count(t)
        m = int(streams.left[t])
        at, found = model.contexts(m)
        index, sure = found >> _BITS, found & _THREE
        key = _classes(index[0], index[1], sure[0], sure[1])
        key_at = key + model.class_at[:m]
        end0, end1 = model.end0.take(key_at), model.end1.take(key_at)
        code_m, width_m = code[:m], width[:m]
        unit = np.floor(width_m * (1 / _PARTS))
        point = np.floor(code_m / unit)
        kept, is2 = point >= end0, point >= end1
        np.add(key, (kept.view(np.uint8) + is2.view(np.uint8)) * np.uint8(_CLASSES), out=model.log[t - model.counted, :m], casting="unsafe")
        begin, end = np.where(is2, end1, end0), np.where(is2, _PARTS, end1)
        x = model.seen[t, :m]
        x[:] = np.where(is2, index[0], index[1])
        # Where no kept prediction was right, order 0 gives the index: a slot of the guide, then halves of the slot.
        miss = np.flatnonzero(point < end0)
        total, part, cum_at = model.total.take(miss), end0.take(miss), model.cum_at.take(miss)
        wanted = np.floor(((point.take(miss) + 1) * total - 1) / part).astype(np.uint16)
        y = cum_at - 1 + model.guide.take(model.guide_at.take(miss) + (wanted // np.uint16(_SLOT)))
        for half in _HALVES:
            y += (model.flat.take(y + half) <= wanted) * half
        x[miss] = y - cum_at
        begin[miss] = np.floor(model.flat.take(y) * part / total)
        end[miss] = np.floor(model.flat.take(y + 1) * part / total)
        code_m -= begin * unit
        np.multiply(end - begin, unit, out=width_m)
        full = np.flatnonzero(width_m < _WORD)
        word = word_at.take(full)
        code_m[full] = code_m.take(full) * _WORD + flat.take(word)
        word_at[full] = word + 1
        width_m[full] = width_m.take(full) * _WORD
        model.update(m, x, at, found, index, sure)
    result = [np.zeros(n, np.uint32) for n in sizes]
    rows = np.ascontiguousarray(model.seen.T)
    for row, i, begin, end in zip(rows, streams.block.tolist(), streams.begin.tolist(), streams.end.tolist()):
        result[i][begin:end] = alphabets[i][row[:end - begin]]
    return result


# ----------------------------------------------------------------- block bodies
def body(docs: np.ndarray, n_ids: int, words: np.ndarray, first_doc: int, first_id: int) -> bytes:
    """A block: header (magic, counts, place in the file), document table, code words, crc32."""
    out = _HEAD.pack(_MAGIC, n_ids, len(docs), len(words), first_doc, first_id) + docs.tobytes() + words.astype("<u4").tobytes()
    return out + struct.pack("<I", zlib.crc32(out))


def parse(data: bytes) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    """``(n_ids, first_doc, first_id, docs, words)`` of a block; raises ValueError on damage."""
    if len(data) < _HEAD.size + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("block checksum does not match")
    magic, n, n_docs, n_words, first_doc, first_id = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a block of token ids")
    at = _HEAD.size + n_docs * _DOC.itemsize
    return n, first_doc, first_id, np.frombuffer(data, _DOC, n_docs, _HEAD.size), np.frombuffer(data, "<u4", n_words, at)


# ------------------------------------------------------------------- Spark jobs
def write(df: DataFrame, path: str, block: int = BLOCK, lanes: int = LANES, symbols: int = 49_408) -> DataFrame:
    """Write the files in ascending ``doc_id`` order; their table ``shard, block, n_ids, body``.

    Shards are ranges of ``doc_id`` and the first characters of the texts, each
    written by one task; rows equal in both are dealt out by their number.
    """
    schema = "shard int, block int, n_ids long, body binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, shard = word_bpe.encoder(path), TaskContext.get().partitionId()
        tables, data, docs, room = [], [], [], block  # finished blocks and the one being filled
        state = {"doc": 0, "first_doc": 0, "id": 0, "block": 0}

        def documents_of(batches):
            for b in batches:
                for row, ids, offsets in bpe.blocks(b.column(1), word_bpe.END):
                    for doc_id, begin, end in zip(b.column(0).slice(row, len(offsets) - 1).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                        yield doc_id, ids[begin:end]

        def close() -> None:
            nonlocal data, docs, room
            if docs:
                ids = np.concatenate(data)
                tables.append((np.array(docs, _DOC), ids, state["first_doc"], state["id"]))
                state["id"] += len(ids)
            data, docs, room = [], [], block

        def flush() -> pa.RecordBatch:
            words = encode_blocks([t[1] for t in tables], symbols)
            rows = [body(d, len(ids), w, first_doc, first_id) for (d, ids, first_doc, first_id), w in zip(tables, words)]
            out = pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(rows), pa.int32()), pa.array(range(state["block"], state["block"] + len(rows)), pa.int32()),
                 pa.array([len(t[1]) for t in tables], pa.int64()), pa.array(rows, pa.binary())], ["shard", "block", "n_ids", "body"])
            state["block"] += len(rows)
            tables.clear()
            return out

        for doc_id, ids in documents_of(batches):
            at = 0
            while at < len(ids):
                take = min(room, len(ids) - at)
                if not docs:
                    state["first_doc"] = state["doc"]
                docs.append((doc_id is not None, doc_id or 0, at, take, len(ids)))
                data.append(ids[at:at + take])
                at, room = at + take, room - take
                if not room:
                    close()
                    if len(tables) == lanes:
                        yield flush()
            state["doc"] += 1
        close()
        if tables:
            yield flush()

    numbered = documents(df).withColumn("row", F.monotonically_increasing_id())
    ordered = numbered.repartitionByRange("doc_id", F.substring("text", 1, PREFIX), "row").sortWithinPartitions("doc_id", F.substring("text", 1, PREFIX), "row")
    return stored(ordered.select("doc_id", "text").mapInArrow(run, schema), "id-files")


def read(files: DataFrame, lanes: int = LANES, symbols: int = 49_408) -> DataFrame:
    """Document pieces with their ids, from the blocks: ``shard, doc, doc_id, from_id, n, doc_tokens, shard_start, ids``."""
    return _decoded(files, lanes, symbols, True)


def _decoded(files: DataFrame, lanes: int, symbols: int, with_ids: bool) -> DataFrame:
    schema = "shard int, doc long, doc_id long, from_id long, n long, doc_tokens long, shard_start long, " + ("ids binary" if with_ids else "crc long")

    def pieces(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        parsed = [parse(data) for _, data in rows]
        ids = decode_blocks([p[4] for p in parsed], [p[0] for p in parsed], symbols)
        out: list[list] = [[] for _ in range(8)]
        for (shard, _), (_, first_doc, first_id, docs, _), x in zip(rows, parsed, ids):
            raw, at = x.astype("<u4").tobytes(), 0
            for k, (has_id, doc_id, start, n, of) in enumerate(docs.tolist()):
                piece = raw[4 * at:4 * (at + n)]
                for column, v in zip(out, (shard, first_doc + k, doc_id if has_id else None, start, n, of, first_id + at, piece if with_ids else zlib.crc32(piece))):
                    column.append(v)
                at += n
        kinds = [pa.int32()] + [pa.int64()] * 6 + [pa.binary() if with_ids else pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], [f.split()[0] for f in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, bytes]] = []
        for b in batches:
            for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows.append(r)
                if len(rows) == lanes:
                    yield pieces(rows)
                    rows = []
        if rows:
            yield pieces(rows)

    return files.select("shard", "body").mapInArrow(run, schema)


def summary(files: DataFrame, lanes: int = LANES, symbols: int = 49_408) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    found = stored(_decoded(files, lanes, symbols, False), "id-pieces")
    whole = found.where("n = doc_tokens").select("shard", "doc_id", "shard_start", "doc_tokens", F.col("crc").alias("ids_crc32"))
    parts = found.where("n < doc_tokens").groupBy("shard", "doc").agg(
        F.first("doc_id").alias("doc_id"), F.min("shard_start").alias("shard_start"), F.first("doc_tokens").alias("doc_tokens"),
        F.sort_array(F.collect_list(F.struct("from_id", "n", "crc"))).alias("parts"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crcs = []
            for p in b.column(4).to_pylist():
                crc = p[0]["crc"]
                for x in p[1:]:
                    crc = word_bpe.crc32_join(crc, x["crc"], 4 * x["n"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(crcs, pa.int64())], ["shard", "doc_id", "shard_start", "doc_tokens", "ids_crc32"])

    parts = parts.select("shard", "doc_id", "shard_start", "doc_tokens", "parts").mapInArrow(
        joined, "shard int, doc_id long, shard_start long, doc_tokens long, ids_crc32 long")
    # One row per shard, that is per task of the writer: broadcast.
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    totals = totals.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base"))
    return whole.unionByName(parts).join(F.broadcast(totals), "shard").select(
        "doc_id", (F.col("base") + F.col("shard_start")).cast("long").alias("start"), F.col("doc_tokens").alias("n_tokens"), "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: one row per document."""
    import public_tokenizers

    return summary(write(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(word_bpe.VOCABULARY)))
