"""Personal data: pattern spans, and spans of a conditional random field over word shapes.

Base spans are e-mail addresses, IPv4 addresses, card numbers and phone
numbers by fixed patterns.  A linear-chain conditional random field over the
shapes of words is trained from a small labelled table and decoded by
Viterbi in numpy batches; it adds spans of what patterns miss (credentials,
account and identity numbers), where no base match or failed match lies.

Words of letters alone, unless a cue word comes before, admit only the
label outside.  A path's best continuation depends on nothing before such a
word, so Viterbi runs over the stretches between them, of all texts of a
batch at once, with the result of a run over whole texts.

Defined results: a NULL or empty text has no spans; rows that repeat a
``doc_id`` are scanned one by one; texts of any length are scanned whole;
positions are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import crf
from .common import documents, rows_of, word_hashes, words

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "account")
_ORDER = {k: i for i, k in enumerate(BASE + ADDED)}
#: Labels of the field: outside, the base kinds, the added kinds.
LABELS = ("", *BASE, *ADDED)

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Each @ in turn, with the run of address characters before it: no text is scanned twice."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        i = at
        while i > last and (text[i - 1].isascii() and (text[i - 1].isalnum() or text[i - 1] in "._%+-")):
            i -= 1
        m = _DOMAIN.match(text, at) if i < at else None
        if m:
            out.append((i, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    return out


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """Spans that pass, and the places of failed matches."""
    good, failed = [("email", a, b) for a, b in _emails(text)], []
    for kind, pattern, passes in (
        ("ip", _IP, lambda s: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))),
        ("card", _CARD, lambda s: 12 <= len(d := re.sub(r"[ -]", "", s)) <= 19 and luhn(d)),
        ("phone", _PHONE, lambda s: 9 <= sum(c.isdigit() for c in s) <= 15),
    ):
        for m in pattern.finditer(text):
            if passes(m.group()):
                good.append((kind, *m.span()))
            elif kind != "card":  # numbers that are no cards are left to the field
                failed.append(m.span())
    return sorted(good, key=lambda s: (s[1], _ORDER[s[0]], s[2])), failed


# ------------------------------------------------------------------- word shapes
_CLASS = np.full(256, 9, np.uint8)
for _k, _chars in enumerate((range(48, 58), range(65, 91), [*range(97, 123), *range(128, 256)], b"@", b"=", b".", b",;!?\"'`", b"-_", b"+():/")):
    _CLASS[list(_chars)] = _k
#: Words before or inside a credential or an account number.
CUES = ("password", "passwd", "pwd", "token", "secret", "key", "api_key", "apikey", "access_key", "=", ":", "iban", "ssn", "account", "passport", "password:", "token:", "key:", "iban:", "ssn:")
_CUES = np.sort(word_hashes(*(lambda d: (np.frombuffer(d, np.uint8), np.cumsum([0] + [len(w.encode()) + 1 for w in CUES[:-1]]),
                                         np.cumsum([len(w.encode()) + 1 for w in CUES]) - 1))((" ".join(CUES) + " ").encode())))


def shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, first word of each text, plain, features)``; features are of words that are not plain, or after a cue."""
    starts, ends, first = words(data, offsets)
    kinds = _CLASS[data]
    odd = np.flatnonzero((kinds == 0) | (kinds == 3) | (kinds == 4) | (kinds >= 7))
    plain = np.searchsorted(odd, ends) == np.searchsorted(odd, starts)
    cue = np.isin(word_hashes(data, starts, ends), _CUES) if len(starts) else np.zeros(0, bool)
    after = np.zeros(len(starts), bool)
    after[1:] = cue[:-1]
    after[first[:-1][first[:-1] < len(starts)]] = False
    return starts, ends, first, plain & ~after, _features(data, kinds, starts, ends, cue, after)


def _features(data: np.ndarray, kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray, cue: np.ndarray, after: np.ndarray):
    def of(rows: np.ndarray) -> np.ndarray:
        s, e = starts[rows], ends[rows]
        n = e - s
        owner = np.repeat(np.arange(len(rows)), n)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(s, n)
        count = np.bincount(owner * 10 + kinds[at], minlength=10 * len(rows)).reshape(-1, 10).astype(float)
        byte = data[at]
        hexes = np.bincount(owner, ((byte >= 48) & (byte <= 57)) | ((byte >= 97) & (byte <= 102)), len(rows))
        digit, upper, lower = count[:, 0], count[:, 1], count[:, 2]
        size = np.maximum(1, n)
        change = np.bincount(owner[1:], (kinds[at][1:] != kinds[at][:-1]) & (owner[1:] == owner[:-1]), len(rows)) if len(at) > 1 else np.zeros(len(rows))
        return np.column_stack([
            np.ones(len(rows)), digit == 0, digit == size, (digit > 0) & (digit < size), digit / size,
            (digit >= 1) & (digit <= 2), (digit >= 3) & (digit <= 4), (digit >= 5) & (digit <= 8), (digit >= 9) & (digit <= 11), digit >= 12,
            n <= 5, (n > 5) & (n < 12), (n >= 12) & (n < 20), n >= 20,
            count[:, 3] > 0, count[:, 4] > 0, count[:, 5] >= 3, count[:, 5] > 0, count[:, 7] > 0, count[:, 8] > 0,
            (upper > 0) & (digit > 0) & (lower == 0), (upper > 0) & (digit > 0) & (lower > 0), (hexes >= 0.9 * size) & (n >= 16) & (digit > 2),
            (hexes >= 0.6 * size) & (n >= 16) & (digit > 4), change >= 5, cue[rows], after[rows], after[rows] & (digit > 0) & (n >= 8),
            (count[:, 4] > 0) & (digit >= 3) & (n >= 16), (lower + upper + count[:, 6] + count[:, 5] >= size),
        ]).astype(float)

    return of


# ------------------------------------------------------------ the labelled table
def labelled_rows(n: int = 240) -> list[tuple[str, list[str]]]:
    """The training table: sentences of labelled words, drawn by a rule from fixed patterns (seeded)."""
    rng = random.Random(11)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    caps = lambda k: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(k))
    plain = lambda: "".join(rng.choice(("an", "the", "re", "on", "ti", "ou", "ing", "er", "é", "lo", "sch", "ción")) for _ in range(rng.randrange(1, 5)))
    # Each pattern: words with their label.
    patterns = [
        lambda: [(f"{plain()}.{digits(2)}@mail{digits(1)}.example.com", "email")], lambda: [(f"{plain()}@host.org,", "email")],
        lambda: [(f"{rng.randrange(1, 99)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}", "ip")],
        lambda: [(f"4{digits(15)}", "card")], lambda: [(digits(4), "card") for _ in range(4)], lambda: [("-".join(digits(4) for _ in range(4)), "card")],
        lambda: [("+1", "phone"), (f"({digits(3)})", "phone"), (f"{digits(3)}-{digits(4)}", "phone")], lambda: [(f"+49{digits(9)}", "phone")],
        lambda: [(f"password={hexes(18)}", "secret")], lambda: [("token", ""), ("=", ""), (f'"{hexes(40)}"', "secret")], lambda: [(f"AKIA{caps(16)}", "secret")],
        lambda: [("api_key", ""), ("=", ""), (f"{hexes(32)}", "secret")], lambda: [("password:", ""), (f"{plain()}{digits(4)}{plain()}{digits(3)}", "secret")],
        lambda: [(f"secret={caps(24)}{digits(3)}", "secret")], lambda: [(f"key={hexes(20)}", "secret")],
        lambda: [("iban", ""), (f"DE{digits(20)}", "account")], lambda: [("ssn", ""), (f"{digits(3)}-{digits(2)}-{digits(4)}", "account")],
        lambda: [("account", ""), (digits(10), "account")],
    ]
    # Numbers and marks that are nothing personal.
    clean = [
        lambda: [(str(rng.randrange(1900, 2030)) + rng.choice(("", ".", ",")), "")], lambda: [("version", ""), (f"{rng.randrange(1, 9)}.{rng.randrange(10)}", "")],
        lambda: [("Version", ""), ("2.0.", "")], lambda: [("CC", ""), ("BY-NC", ""), ("4.0.", "")], lambda: [(f"${digits(2)}.{digits(2)}", "")],
        lambda: [(f"{plain()}-{plain()}", "")], lambda: [("#", "")], lambda: [(plain() + "###", "")], lambda: [("|", "")], lambda: [(digits(rng.randrange(1, 6)), "")],
        lambda: [(f"{digits(2)}/{digits(2)}/{digits(4)}", "")], lambda: [(f"{digits(2)}:{digits(2)}", "")], lambda: [("the", ""), ("key", ""), (plain(), "")],
        lambda: [("token", ""), (plain(), "")], lambda: [("password", ""), (plain(), "")], lambda: [(plain() + "%%%", "")], lambda: [("x", ""), ("=", ""), (digits(2), "")],
        lambda: [(f"http://www.{plain()}.com/{plain()}/{digits(3)}", "")], lambda: [(f"{digits(1)},{digits(3)},{digits(3)}", "")], lambda: [("account", ""), (plain(), "")],
        lambda: [(f"ISBN {digits(3)}-{digits(10)}", "")], lambda: [(plain().upper() + "!!", "")], lambda: [(f"{plain()}_{plain()}({plain()})", "")], lambda: [("=", ""), (plain(), "")],
    ]
    rows = []
    for i in range(n):
        found = []
        for j in range(4):
            found += [(plain() + rng.choice(("", "", ",", ".")), "") for _ in range(rng.randrange(1, 4))]
            found += (patterns[(i + 5 * j) % len(patterns)] if j % 2 else clean[(i + 7 * j) % len(clean)])()
        found.append((plain() + ".", ""))
        found = [(w, k) for words_, k in found for w in words_.split()]
        rows.append((" ".join(w for w, _ in found), [k for _, k in found]))
    return rows


def train(rows: list[tuple[str, list[str]]]) -> crf.CRF:
    """The field from a labelled table of texts and their words' labels."""
    texts = [t.encode() for t, _ in rows]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, _, first, _, features = shapes(data, offsets)
    labels = np.array([LABELS.index(k) for _, ks in rows for k in ks])
    return crf.train(features(np.arange(len(starts))), labels, first, len(LABELS), rounds=300, l2=1e-4)


def _field_spans(data: np.ndarray, offsets: np.ndarray, model: crf.CRF, split: bool = True) -> dict[int, list[tuple[str, int, int]]]:
    """By text of the block: label and byte place (in the text) of stretches of added kinds."""
    starts, ends, first, plain, features = shapes(data, offsets)
    if not len(starts):
        return {}
    use = ~plain
    if split:
        # The plain word on either side, within the text, anchors a stretch.
        begins = np.zeros(len(starts), bool)
        begins[first[:-1][first[:-1] < len(starts)]] = True
        near = use.copy()
        near[:-1] |= use[1:] & ~begins[1:]
        near[1:] |= use[:-1] & ~begins[1:]
        rows = np.flatnonzero(near)
        if not len(rows):
            return {}
        new = np.ones(len(rows), bool)
        new[1:] = (np.diff(rows) > 1) | begins[rows[1:]]
        at = np.concatenate([np.flatnonzero(new), [len(rows)]])
    else:
        rows, at = np.arange(len(starts)), first
    e = model.emissions(features(rows))
    e[plain[rows], 1:] = -1e9
    labels = crf.viterbi(e, at, model)
    out: dict[int, list[tuple[str, int, int]]] = {}
    found = np.flatnonzero(labels > len(BASE))
    doc = np.searchsorted(first, rows[found], "right") - 1
    previous = None
    for i, d in zip(found.tolist(), doc.tolist()):
        kind, s, e = LABELS[labels[i]], int(starts[rows[i]] - offsets[d]), int(ends[rows[i]] - offsets[d])
        spans = out.setdefault(d, [])
        if spans and previous == (d, int(rows[i]) - 1, kind):
            spans[-1] = (kind, spans[-1][1], e)
        else:
            spans.append((kind, s, e))
        previous = (d, int(rows[i]), kind)
    return out


_TRIM = b"\"'`,;.!?()[]{}<>"


def find(data: np.ndarray, offsets: np.ndarray, model: crf.CRF, split: bool = True) -> list[tuple[list, list]]:
    """For every text of a block: base spans, and all spans.  Without ``split`` Viterbi runs over whole texts."""
    field = _field_spans(data, offsets, model, split)
    marks = np.flatnonzero((data == 64) | ((data >= 48) & (data <= 57)))
    flagged = np.searchsorted(marks, offsets[1:]) > np.searchsorted(marks, offsets[:-1])
    out = []
    for d in range(len(offsets) - 1):
        if not flagged[d] and d not in field:
            out.append(([], []))
            continue
        raw = data[offsets[d]:offsets[d + 1]].tobytes()
        text = raw.decode()
        base, failed = base_spans(text) if flagged[d] else ([], [])
        taken, added = [(a, b) for _, a, b in base] + failed, []
        for kind, s, e in field.get(d, ()):
            cut = raw.rfind(b"=", s, e - 4) + 1  # the value of name=value
            s = max(s, cut)
            while s < e and raw[s] in _TRIM:
                s += 1
            while e > s and raw[e - 1] in _TRIM:
                e -= 1
            a = len(raw[:s].decode())
            b = a + len(raw[s:e].decode())
            if b > a and not any(x < b and a < y for x, y in taken):
                added.append((kind, a, b))
        out.append((base, sorted(base + added, key=lambda x: (x[1], _ORDER[x[0]], x[2]))))
    return out


def line(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(df: DataFrame, rows: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """``doc_id``, counts of base kinds, ``base_sha256`` and ``spans`` of every row."""
    model = train(labelled_rows() if rows is None else rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, end, data, offsets in rows_of(b):
                found = find(data, offsets, model)
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in BASE]
                digests = [hashlib.sha256(line(base).encode()).hexdigest() for base, _ in found]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, end - row), *counts, pa.array(digests), pa.array([line(s) for _, s in found])],
                                                 ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return documents(df).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans: str) -> str:
    """The text with each span replaced by its kind in angle brackets (overlapping spans as one)."""
    out, last = [], 0
    for part in spans.split(",") if spans else ():
        kind, a, b = part.split(":")
        a, b = int(a), int(b)
        if a >= last:
            out += [text[last:a], f"<{kind}>"]
        last = max(last, b)
    return "".join(out) + text[last:]


def query(spark, sf_dir: str) -> DataFrame:
    """op7: one row per document."""
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
