"""Ids of the word-level BPE of the tokenizers library, whole texts, a block of texts at a time.

The vocabulary drops white space and no pre-token, normalisation or merge
crosses a space, so a text's ids are its space-separated words' ids, one
after the other.  A block's words are dictionary-encoded.  A distinct word of
plain letters with signs after them is two units, its lower-cased letters and
its signs, each a pre-token of its own that the normalisation leaves as it is;
any other word is one unit.  Units not seen before are encoded by the library
(plain ones without its normaliser and pattern), and the ids of all occurrences
are gathered by their numbers.  Units and ids that were seen are kept as flat
Arrow and numpy arrays, about 40 bytes a unit, of at most ``KNOWN`` units and
one block's more; the half used longest ago goes when there are more.

Texts that hold the vocabulary's special tokens get their ids, as the
library gives them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import held, release

VOCABULARY = "word_bpe_49k.json"
END = 1
#: Bytes of text that are encoded together (a longer text is a block of its own).
BLOCK_BYTES = 2 << 20
KNOWN = 300_000
_TOGETHER, _CALL = 256, 64
#: A word of this character stands between words that are encoded together.
_MARK = "\x01"
#: Letters whose lower case is one letter and that NFC leaves alone, then ASCII signs.
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-/:-@\[-`{-~"
_PLAIN = f"^(?P<letters>[{_LETTERS}]*)(?P<signs>[{_SIGNS}]*)$"
_UNIT = f"^([{_LETTERS}]+|[{_SIGNS}]+)$"
_SUFFIX = "</w>"


class WordBPE:
    """``blocks`` gives the ids of a column of texts; ``encode`` those of one."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.mark = self._ids([_MARK])[0]
        # The same model for pre-tokens with spaces between them; each ends with the one id that closes a word.
        self.units = Tokenizer(self.tokenizer.model)
        self.units.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for w, i in vocabulary.items() if w.endswith(_SUFFIX)]] = True
        self.known = pa.array([], pa.large_utf8())
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.used, self.turn = np.zeros(0, np.int64), 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, ends)``: the ids of all words, one after the other, and where each word's end."""
        out: list = [None] * len(words)
        plain = [i for i, w in enumerate(words) if _MARK not in w and len(w) <= 1000] if len(self.mark) == 1 else []
        odd = sorted(set(range(len(words))).difference(plain))
        groups = [plain[i:i + _TOGETHER] for i in range(0, len(plain), _TOGETHER)]
        for k in range(0, len(groups), _CALL):
            some = groups[k:k + _CALL]
            for group, ids in zip(some, self._ids([f" {_MARK} ".join([words[i] for i in g]) for g in some])):
                ids = np.array(ids, np.uint32)
                cut = np.flatnonzero(ids == self.mark[0])
                if len(cut) != len(group) - 1:  # a word holds the mark's id itself
                    odd += group
                    continue
                last = 0
                for i, c in zip(group, [*cut.tolist(), len(ids)]):
                    out[i] = ids[last:c]
                    last = c + 1
        for k in range(0, len(odd), _TOGETHER):
            some = odd[k:k + _TOGETHER]
            for i, ids in zip(some, self._ids([words[i] for i in some])):
                out[i] = np.array(ids, np.uint32)
        return np.concatenate([np.zeros(0, np.uint32), *out]), np.cumsum(np.fromiter(map(len, out), np.int64, len(out)))

    def _plain(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What ``words`` gives, for plain units."""
        flat, ends, done = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        for k in range(0, len(units), _TOGETHER * _CALL):
            some = units[k:k + _TOGETHER * _CALL]
            texts = [" ".join(some[i:i + _TOGETHER]) for i in range(0, len(some), _TOGETHER)]
            ids = np.array([x for e in self.units.encode_batch_fast(texts, add_special_tokens=False) for x in e.ids], np.uint32)
            stops = np.flatnonzero(self.closes[ids]) + 1
            if len(stops) != len(some) or stops[-1] != len(ids):  # not a vocabulary that closes words so
                ids, stops = self.words(some)
            flat.append(ids)
            ends.append(stops + done)
            done += len(ids)
        return np.concatenate(flat), np.concatenate(ends)

    def _numbers(self, units: pa.Array) -> np.ndarray:
        """Where each of the distinct ``units`` stands among the known ones, after new ones are added."""
        self.turn += 1
        if len(self.known) > KNOWN:
            keep = np.sort(np.argsort(-self.used, kind="stable")[:KNOWN // 2])
            sizes = np.diff(self.ends, prepend=0)[keep]
            stops = np.cumsum(sizes)
            self.flat = self.flat[np.repeat(self.ends[keep] - stops, sizes) + np.arange(sizes.sum())]
            self.known, self.ends, self.used = self.known.take(pa.array(keep)), stops, self.used[keep]
        at = pc.index_in(units, value_set=self.known)
        lacking = pc.is_null(at).to_numpy(zero_copy_only=False)
        at = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if lacking.any():
            new = units.filter(pa.array(lacking))
            plain = pc.match_substring_regex(new, _UNIT)
            odd = new.filter(pc.invert(plain))
            new = pa.concat_arrays([new.filter(plain), odd])
            plain = plain.to_numpy(zero_copy_only=False)
            n = int(plain.sum())
            at[np.flatnonzero(lacking)[np.argsort(~plain, kind="stable")]] = len(self.known) + np.arange(len(new))
            for flat, ends in (self._plain(new[:n].to_pylist()), self.words(odd.to_pylist())):
                self.ends = np.concatenate([self.ends, ends + len(self.flat)])
                self.flat = np.concatenate([self.flat, flat])
            self.known = pa.concat_arrays([self.known, new])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        self.used[at] = self.turn
        return at

    def _units(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """What ``words`` gives, by way of the units of distinct words."""
        parts = pc.extract_regex(words, _PLAIN)
        plain = parts.is_valid()
        letters, signs = parts.flatten()
        letters = pc.if_else(plain, pc.utf8_lower(letters), words)
        coded = pa.concat_arrays([letters, pc.if_else(plain, signs, "").cast(letters.type)]).dictionary_encode()
        at = self._numbers(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)].reshape(2, -1).T
        ends = self.ends[at]
        sizes = ends - np.where(at > 0, self.ends[at - 1], 0)
        stops = np.cumsum(sizes.ravel())
        ids = self.flat[np.repeat(ends.ravel() - stops, sizes.ravel()) + np.arange(stops[-1] if len(stops) else 0)]
        return ids, stops[1::2]

    def _block(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        flat, ends = self._units(coded.dictionary)
        begins = np.concatenate([[0], ends[:-1]])
        word = coded.indices.to_numpy(zero_copy_only=False)
        sizes = (ends - begins)[word]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        offsets = stops[lists.offsets.to_numpy() - lists.offsets[0].as_py()]  # ids before each text
        ids = flat[np.repeat(begins[word] - stops[:-1], sizes) + np.arange(stops[-1])]
        if end is None:
            return ids, offsets
        more = np.arange(len(offsets))
        out = np.full(len(ids) + len(texts), end, np.uint32)
        out[np.repeat(more[:-1], np.diff(offsets)) + np.arange(len(ids))] = ids
        return out, offsets + more

    def blocks(self, texts: pa.Array, end: int | None = None, most: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(first row, ids, offsets)`` of blocks of texts, each text's ids followed by ``end`` if given.  NULL is empty."""
        texts = pc.fill_null(texts.cast(pa.large_utf8()), "")
        sums = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        row = 0
        while row < len(texts):
            before = sums[row - 1] if row else 0
            stop = max(row + 1, int(np.searchsorted(sums, before + most, "right")))
            yield row, *self._block(texts.slice(row, stop - row), end)
            row = stop
        release()

    def encode(self, text: str) -> bytes:
        """The ids of one text as little-endian uint32 bytes."""
        return self._block(pa.array([text], pa.large_utf8()), None)[0].astype("<u4").tobytes()


def encoder(path: str) -> WordBPE:
    """The worker's encoder for a vocabulary file (read once in each Python worker)."""
    return held(("word_bpe", path), lambda: WordBPE(path))


# -------------------------------------------------------------- crc32 algebra
def _times(matrix: list[int], v: int) -> int:
    out = 0
    for row in matrix:
        if not v:
            return out
        if v & 1:
            out ^= row
        v >>= 1
    return out


def _byte_matrices() -> list[list[int]]:
    """Operators that carry a crc32 over 2**k zero bytes."""
    bit = [0xEDB88320] + [1 << i for i in range(31)]
    for _ in range(3):
        bit = [_times(bit, r) for r in bit]
    out = [bit]
    for _ in range(47):
        out.append([_times(out[-1], r) for r in out[-1]])
    return out


_ZEROS = _byte_matrices()


def crc32_join(left: int, right: int, right_bytes: int) -> int:
    """The crc32 of two byte strings together, from their crc32s and the second's length."""
    k = 0
    while right_bytes:
        if right_bytes & 1:
            left = _times(_ZEROS[k], left)
        right_bytes >>= 1
        k += 1
    return left ^ right
