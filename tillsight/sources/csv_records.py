"""Splittable CSV: records with quoted newlines, cut inside the splits of one large file.

Whether a line starts inside a quoted field depends on everything before
it.  A line is a function on two states (0: at a record's start, 1: inside
quotes), and so is a run of lines; functions of two states compose to one of
four: constant 0, constant 1, identity, exchange.

1. Each split (a byte range of a file, one task's share) composes the
   functions of its lines and keeps its first record and whether its bytes
   are valid UTF-8: one row per split.
2. A prefix scan over each file's splits in byte order, as window sums,
   gives the state in which every split starts.
3. Each split cuts its records, knowing that state.  A record that crosses
   a border leaves an unfinished end in one split and the rest in the next
   ones; these pieces (two per split at most) are joined by file.

The input is read twice, whatever the number and size of files; nothing
but the paths passes through the driver.

Rules: fields are separated by commas; quotes are special at the start of a
field only, and doubled inside one; empty lines are no records; a carriage
return before a newline is not part of a record; a byte-order mark is not
part of the header; a quoted field that never ends takes the rest of its
file.  A file with bytes that are not UTF-8 is read as ISO-8859-1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..operators.headers import CANONICAL, mapping_table
from ..session import broadcast_if_bounded, cut_lineage

#: Splits that start inside quotes, and files, of which the tables are broadcast if counted to be fewer.
MAX_BROADCAST = 200_000

# A field and the comma after it: quoted text and what follows its closing quote, or plain text.
_FIELD = re.compile(r'(?:"([^"]*(?:""[^"]*)*)(?:"([^,]*))?|([^,]*)),')
# A record's start, then whole fields up to an opening quote that does not close.
_OPEN = re.compile(rb'(?:(?:"(?:[^"]|"")*+"(?!")[^,]*+|[^",][^,]*+)?,)*+"(?:[^"]|"")*+\Z')


def ends_inside(line: bytes, inside: bool) -> bool:
    """The state after a line, from the state before it."""
    if b'"' not in line:
        return inside
    return _OPEN.match(b'"' + line if inside else line) is not None


def lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``path, start, pos, value, utf8``: every line as bytes, with its split and its order within the task."""
    text = spark.read.option("lineSep", "\n").text(list(paths))
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                       F.monotonically_increasing_id().alias("pos"), F.col("value").cast("binary").alias("value"),
                       F.is_valid_utf8("value").alias("utf8"))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(path, start, rows)`` runs of lines, in file order; a run may come in several parts."""
    for b in batches:
        paths, starts = b.column(0).to_pylist(), b.column(1).to_pylist()
        rows = list(zip(*(b.column(i).to_pylist() for i in range(2, b.num_columns))))
        i = 0
        while i < len(rows):
            j = i + 1
            while j < len(rows) and starts[j] == starts[i] and paths[j] == paths[i]:
                j += 1
            yield paths[i], starts[i], rows[i:j]
            i = j


_SPLIT = "path string, start long, from_outside int, from_inside int, utf8 boolean, header binary"


def split_functions(found: DataFrame) -> DataFrame:
    """One row per split: its lines' composed function, its encoding, and the first record of a file's first split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("from_outside", pa.int32()), ("from_inside", pa.int32()),
                            ("utf8", pa.bool_()), ("header", pa.binary())])
        now, state, utf8, head, whole = None, [False, True], True, [], False

        def row() -> pa.RecordBatch:
            header = b"\n".join(head) if now[1] == 0 else None
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*now, *map(int, state), utf8, header), schema)], schema=schema)

        for path, start, rows in _splits(batches):
            if (path, start) != now:
                if now is not None:
                    yield row()
                now, state, utf8, head, whole = (path, start), [False, True], True, [], start != 0
            for value, valid in rows:
                utf8 = utf8 and valid
                state = [ends_inside(value, state[0]), ends_inside(value, state[1])] if b'"' in value else state
                if not whole and (head or value.strip(b"\r")):
                    head.append(value)
                    whole = not state[0]
        if now is not None:
            yield row()

    return found.select("path", "start", "value", "utf8").mapInArrow(run, _SPLIT)


def start_states(splits: DataFrame) -> DataFrame:
    """``path, start, inside, after``: the states in which every split starts and ends.

    The state after a split is that of the last constant up to it, exchanged once for every exchange since.
    """
    upto = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    a, b = F.col("from_outside"), F.col("from_inside")
    d = splits.withColumn("turns", F.sum((a > b).cast("int")).over(upto))
    d = d.withColumn("base", F.when(a == b, (a + F.col("turns")) % 2))
    d = d.withColumn("after", ((F.coalesce(F.last("base", ignorenulls=True).over(upto), F.lit(0)) + F.col("turns")) % 2).cast("int"))
    before = F.lag("after", 1, 0).over(Window.partitionBy("path").orderBy("start"))
    return d.select("path", "start", before.alias("inside"), "after")


def fields_of(record: bytes, utf8: bool) -> list[str]:
    """The fields of one record."""
    text = record.decode("utf-8" if utf8 else "iso-8859-1").removesuffix("\r")
    if '"' not in text:
        return text.split(",")
    quoted = lambda m: m[1].replace('""', '"') + (m[2] or "")
    return [m[3] if m[1] is None else quoted(m) for m in _FIELD.finditer(text + ",")]


_RECORD_SCHEMA = pa.schema([("path", pa.string()), ("start", pa.int64()), ("pos", pa.int64()), ("head", pa.bool_()), ("piece", pa.int32()),
                            ("fields", pa.list_(pa.string())), ("value", pa.binary()), ("utf8", pa.bool_())])
_RECORD = "path string, start long, pos long, head boolean, piece int, fields array<string>, value binary, utf8 boolean"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of splits from ``path, start, pos, value, utf8, inside``; pieces 1 (rest of an earlier record) and 2 (unfinished).

    ``head`` marks the first record of a file.
    """
    now, state, first, utf8, parts, piece, head = None, False, 0, True, [], 0, False
    out: list[tuple] = []

    def close(kind: int) -> None:
        nonlocal head
        record = b"\n".join(parts)
        parts.clear()
        if kind or record.strip(b"\r"):
            out.append((*now, first, head, kind, None if kind else fields_of(record, utf8), record if kind else None, utf8))
            head = False

    def batch() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_RECORD_SCHEMA)], schema=_RECORD_SCHEMA)
        out.clear()
        return rows

    for path, start, rows in _splits(batches):
        if (path, start) != now:
            if parts:
                close(piece or 2)
            now, state = (path, start), bool(rows[0][3])
            piece, head = int(state), start == 0
        for pos, value, valid, _ in rows:
            if not parts:
                first, utf8 = pos, valid
            parts.append(value)
            state = ends_inside(value, state)
            if not state:
                close(piece)
                piece = 0
        if len(out) >= 4096:
            yield batch()
    if parts:
        close(piece or 2)
    yield batch()


def csv_records(spark: SparkSession, paths: Sequence[str], splits: DataFrame | None = None) -> DataFrame:
    """``path, start, pos, head, fields`` of every record; ``(start, pos)`` orders a file's records, ``head`` marks its first."""
    if not paths:
        return spark.createDataFrame([], "path string, start long, pos long, head boolean, fields array<string>")
    splits = cut_lineage(split_functions(lines(spark, paths))) if splits is None else splits
    states = cut_lineage(start_states(splits))
    wrong = splits.where("NOT utf8").select("path").distinct().withColumn("latin", F.lit(True))
    inside = states.where("inside = 1").select("path", "start", "inside")
    bounded = max(x.limit(MAX_BROADCAST + 1).count() for x in (inside, wrong)) <= MAX_BROADCAST

    def cut(found: DataFrame) -> DataFrame:
        hint = F.broadcast if bounded else lambda x: x
        d = found.drop("utf8").join(hint(wrong), "path", "left").join(hint(inside), ["path", "start"], "left")
        d = d.select("path", "start", "pos", "value", F.col("latin").isNull().alias("utf8"), F.coalesce("inside", F.lit(0)).alias("inside"))
        if not bounded:  # a broadcast join keeps the order of lines; a shuffle does not
            d = d.repartition("path", "start").sortWithinPartitions("path", "start", "pos")
        return d.mapInArrow(_cut, _RECORD)

    whole = cut(lines(spark, paths)).where("piece = 0").select("path", "start", "pos", "head", "fields")
    edges = states.where("inside = 1 OR after = 1").select("path", "start")
    if edges.isEmpty():
        return whole
    # Only splits with an open border are cut again.
    border = lines(spark, paths).join(broadcast_if_bounded(edges, MAX_BROADCAST), ["path", "start"], "left_semi")
    return whole.unionByName(_crossing(cut(border).where("piece > 0")))


def _crossing(pieces: DataFrame) -> DataFrame:
    """Records that cross borders: every unfinished piece with the rests up to the next one."""
    order = Window.partitionBy("path").orderBy("start", "pos").rowsBetween(Window.unboundedPreceding, 0)
    d = pieces.withColumn("number", F.sum((F.col("piece") == 2).cast("int")).over(order))
    d = d.groupBy("path", "number").agg(
        F.min(F.struct("start", "pos")).alias("at"), F.max("head").alias("head"), F.first("utf8").alias("utf8"),
        F.array_sort(F.collect_list(F.struct("start", "pos", "value"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields = [fields_of(b"\n".join(p["value"] for p in parts), utf8) for parts, utf8 in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(fields, pa.list_(pa.string()))], ["path", "start", "pos", "head", "fields"])

    return d.select("path", "at.start", "at.pos", "head", "parts", "utf8").mapInArrow(
        run, "path string, start long, pos long, head boolean, fields array<string>")


# ------------------------------------------------------------------- tables
def file_headers(splits: DataFrame) -> DataFrame:
    """``dataset_id, names, labels``: the header of every file, and its names made unique (``x``, ``x.1``, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, labels = [], []
            for header, utf8 in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                names.append(fields_of((header or b"").removeprefix(b"\xef\xbb\xbf"), utf8))
                used: dict[str, int] = {}
                for x in names[-1]:
                    label = x
                    while label in used:
                        label = f"{x}.{used[x]}"
                        used[x] += 1
                    used[label] = 1
                labels.append(list(used))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.list_(pa.string())), pa.array(labels, pa.list_(pa.string()))],
                                             ["dataset_id", "names", "labels"])

    whole = splits.groupBy("path").agg(F.min_by("header", "start").alias("header"), F.bool_and("utf8").alias("utf8"))
    return whole.mapInArrow(run, "dataset_id string, names array<string>, labels array<string>")


def scan_csv(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(records, rejected, files)`` of CSV files with header lines.

    ``records``: ``dataset_id, start, pos, labels, fields`` with missing fields as NULL; ``rejected``: records of
    more fields than the header, as they are; ``files``: ``dataset_id, names, labels``.  ``start, pos`` order a
    file's records.
    """
    if not paths:
        empty = spark.createDataFrame([], "dataset_id string, start long, pos long, labels array<string>, fields array<string>")
        return empty, empty, empty.selectExpr("dataset_id", "labels AS names", "labels")
    splits = cut_lineage(split_functions(lines(spark, paths)))
    files = cut_lineage(file_headers(splits))
    d = csv_records(spark, paths, splits).where("NOT head").withColumnRenamed("path", "dataset_id")
    d = d.join(broadcast_if_bounded(files, MAX_BROADCAST), "dataset_id").select("dataset_id", "start", "pos", "labels", "fields")
    width, n = F.size("labels"), F.size("fields")
    padded = F.concat("fields", F.array_repeat(F.lit(None).cast("string"), F.greatest(width - n, F.lit(0))))
    return d.where(n <= width).withColumn("fields", padded), d.where(n > width), files


def column_nulls(records: DataFrame) -> DataFrame:
    """``dataset_id, pos, column, n_rows, n_null`` of every column of every file."""
    cells = records.select("dataset_id", F.posexplode(F.transform("labels", lambda x, i: F.struct(
        x.alias("column"), clean_text(F.get("fields", i)).isNull().alias("no")))).alias("pos", "cell"))
    return cells.groupBy("dataset_id", "pos", "cell.column").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("cell.no").alias("n_null"))


def sales_columns(records: DataFrame, files: DataFrame) -> DataFrame:
    """Canonical columns as cleaned text (NULL where a file lacks one); every other column of the file in the map ``other``."""
    headers = files.select("dataset_id", F.posexplode("names").alias("pos", "header"))
    mapped = mapping_table(headers).groupBy("dataset_id").agg(
        *[F.max(F.when(F.col("canonical") == c, F.col("pos"))).alias(f"at_{c}") for c in CANONICAL])
    d = records.join(broadcast_if_bounded(mapped, MAX_BROADCAST), "dataset_id", "left")
    pairs = F.transform("labels", lambda x, i: F.struct(x.alias("key"), clean_text(F.get("fields", i)).alias("value"), i.alias("i")))
    taken = F.filter(F.array(*[F.col(f"at_{c}") for c in CANONICAL]), lambda x: x.isNotNull())
    other = F.map_from_entries(F.transform(F.filter(pairs, lambda p: ~F.array_contains(taken, p["i"])), lambda p: F.struct(p["key"], p["value"])))
    return d.select("dataset_id", "start", "pos", *[clean_text(F.get("fields", F.col(f"at_{c}"))).alias(c) for c in CANONICAL],
                    other.alias("other"), F.size("labels").alias("_n_columns"))


def first_records(records: DataFrame, rows: int = 10) -> DataFrame:
    """The first ``rows`` records of every file in file order, under any partitioning: ``dataset_id, n, labels, fields``."""
    order = Window.partitionBy("dataset_id").orderBy("start", "pos")
    return records.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows).select("dataset_id", "n", "labels", "fields")
