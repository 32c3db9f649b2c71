"""Fill-in-middle transformation by repeated-capture matching.

A text is a run of units: white space with the word after it, or trailing
white space.  One ``regex`` match of ``(unit)*`` over the whole text keeps
every repetition of its group: ``ends(1)`` holds the end of every unit, so
its length is the number of units and the two cuts are two of its entries.
A text of more than ``SECTION`` characters is matched in sections that end
where a unit ends (each capture costs about 220 bytes while it is held), so
memory stays bounded by the text itself.

The hash of ``seed:doc_id`` picks two cuts and the form: plain (the text as
it is), ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix,
middle).  Parts are marked, so the exact text can be rebuilt from the output.

Defined results: a NULL text is empty; an empty text, or one that holds a
marker, is plain; a NULL id hashes as the empty string; equal rows give
equal rows; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import documents, texts_of

# The unit, and the markers of the three parts.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

UNITS = regex.compile(f"({UNIT})*")
#: A place where one unit has ended and the next begins.
BOUNDARY = regex.compile(r"(?<=[^\x20\x09-\x0D])[\x20\x09-\x0D]")
SECTION = 1 << 18

#: Share of texts that are rearranged, and of those, the share in ``spm`` form (per cent).
RATE, SPM_RATE = 50, 80


def unit_ends(text: str, section: int = SECTION) -> list[int]:
    """The end of every unit, in code points."""
    if len(text) <= section:
        return UNITS.fullmatch(text).ends(1)
    ends, begin = [], 0
    while begin < len(text):
        cut = BOUNDARY.search(text, begin + section)
        end = cut.start() if cut else len(text)
        ends += UNITS.fullmatch(text, begin, end).ends(1)
        begin = end
    return ends


def transform(doc_id: int | None, text: str, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = 42) -> tuple[int, str, int, int]:
    """``(units, form, first cut, second cut)``; a plain text has both cuts at 0."""
    ends = unit_ends(text)
    n = len(ends)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", 0, 0
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, "spm" if h4 % 100 < spm_rate else "psm", ends[a - 1] if a else 0, ends[b - 1] if b else 0


def arrange(text: str, form: str, first: int, second: int) -> str:
    """The output text."""
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    if form == "spm":
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return text


def restore(output: str, form: str) -> str:
    """The text that ``arrange`` was given, from its output and form alone."""
    if form == "plain":
        return output
    rest, middle = output.split(MIDDLE)
    if form == "psm":
        prefix, suffix = rest[len(PREFIX):].split(SUFFIX)
    else:
        suffix, prefix = rest[len(SUFFIX):].split(PREFIX)
    return prefix + middle + suffix


_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _rows(doc_ids: list, texts: list[str], rate: int, spm_rate: int, seed: int):
    for doc_id, text in zip(doc_ids, texts):
        n, form, first, second = transform(doc_id, text, rate, spm_rate, seed)
        sizes = (None, None) if form == "plain" else (first, second - first)
        yield doc_id, n, form, *sizes, arrange(text, form, first, second)


def _table(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def fill_in_middle(df: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = 42) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: the training text of every row of ``df``."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            yield _table(list(_rows(b.column(0).to_pylist(), texts_of(b), rate, spm_rate, seed)), names, types)

    return documents(df).mapInArrow(run, _SCHEMA)


def digests(df: DataFrame) -> DataFrame:
    """``fill_in_middle`` output with the texts replaced by the digests of the output and of the rebuilt text."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            out, form = b.column(5).to_pylist(), b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array([sha(x) for x in out], types[5]), pa.array([sha(restore(x, f)) for x, f in zip(out, form)], types[6])], names)

    return df.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def _small(batches: Iterator[pa.RecordBatch], most: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of a few rows: Python strings of one slice are held at a time."""
    for b in batches:
        for i in range(0, b.num_rows, most):
            yield b.slice(i, most)


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the digests of every document's transformed and rebuilt text."""
    return digests(fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def oracle() -> str:
    """The same in DuckDB: units by a global match, parts by the lengths of the first units."""
    return rf"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{UNIT}') as u,
         sha256('42:' || coalesce(doc_id::varchar, '')) as s
  from documents),
h as (
  select doc_id, t, u, len(u)::bigint as n, ('0x' || s[1:8])::bigint as h1, ('0x' || s[9:16])::bigint as h2,
         ('0x' || s[17:24])::bigint as h3, ('0x' || s[25:32])::bigint as h4 from d),
c as (
  select doc_id, t, n,
    case when t = '' or contains(t, '{PREFIX}') or contains(t, '{SUFFIX}') or contains(t, '{MIDDLE}') or h3 % 100 >= {RATE} then 'plain'
         when h4 % 100 < {SPM_RATE} then 'spm' else 'psm' end as form,
    coalesce(list_sum(list_transform(u[1:least(h1 % (n + 1), h2 % (n + 1))], lambda x: length(x))), 0)::bigint as a,
    coalesce(list_sum(list_transform(u[1:greatest(h1 % (n + 1), h2 % (n + 1))], lambda x: length(x))), 0)::bigint as b
  from h),
p as (select *, substr(t, 1, a) as pre, substr(t, a + 1, b - a) as mid, substr(t, b + 1) as suf from c)
select doc_id, n, form,
       case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
              else '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid end) as output_sha256,
       sha256(t) as restored_sha256
from p"""
