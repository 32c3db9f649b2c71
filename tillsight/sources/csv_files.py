"""CSV folders as sales datasets (one dataset per file).

Steps, all Spark jobs:

1. :func:`list_files` - a file-system listing (path, size, time; no
   content read); the ingest gate flags wrong extensions, empty and
   (optionally) oversized files.
2. :func:`file_encodings` - per file, UTF-8 or ISO-8859-1 (only when
   ``encoding='auto'``; reads each file once).
3. :func:`file_headers` - the first line of each file, read from the first
   split only, parsed into ``(dataset_id, pos, header)`` rows.
4. Header mapping as a join with the alias table
   (:func:`tillsight.operators.headers.mapping_table`).
5. :func:`read_sales_files` - one CSV read per distinct (header signature,
   encoding) group with a positional all-string schema, projected to the
   canonical names and unioned.  The number of groups is the number of
   distinct export layouts, not the number of files or rows.

Every field is read as text; the reader-level cleaning of missing-value
tokens and surrounding whitespace is applied in the same projection.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import clean_text
from ..operators.headers import CANONICAL, mapping_table
from ..session import cut_lineage

# Accepted file extensions (Excel files must be converted to
# CSV or Parquet first, and are rejected with a reason; see README).
ALLOWED_EXTENSIONS = ("csv",)

# Fields are split on commas outside double quotes.
_SPLIT_OUTSIDE_QUOTES = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


# --------------------------------------------------------------------- S4
def _hadoop_listing(spark: SparkSession, paths: Sequence[str], recursive: bool) -> list[tuple]:
    """(path, length, modified ms) of every file under ``paths``.

    Uses the Hadoop file system listing (as Spark's own file index does):
    metadata only, and unlike a ``binaryFile`` scan it keeps 0-byte files.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(conf)
        if not fs.exists(hp):
            continue
        it = fs.listFiles(hp, recursive)
        while it.hasNext():
            st = it.next()
            name = st.getPath().getName()
            if name.startswith(".") or name.startswith("_"):
                continue
            out.append((st.getPath().toString(), int(st.getLen()), int(st.getModificationTime())))
    return out


def list_files(spark: SparkSession, path: str | Sequence[str],
               extensions: Sequence[str] = ALLOWED_EXTENSIONS,
               max_bytes: int | None = None, recursive: bool = True) -> DataFrame:
    """``(path, file_name, extension, length, modified, accepted, reason)``."""
    paths = [path] if isinstance(path, str) else list(path)
    files = spark.createDataFrame(_hadoop_listing(spark, paths, recursive),
                                  "path string, length long, modified_ms long")
    files = files.select("path", "length", F.timestamp_millis("modified_ms").alias("modified"))
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise(F.lit(""))
    reason = (F.when(~ext.isin(*extensions), F.concat(F.lit("extension '."), ext, F.lit("' not allowed")))
              .when(F.col("length") == 0, F.lit("empty file")))
    if max_bytes is not None:
        reason = reason.when(F.col("length") > max_bytes, F.lit(f"larger than {max_bytes} bytes"))
    return files.select("path", name.alias("file_name"), ext.alias("extension"), "length", "modified",
                        reason.isNull().alias("accepted"), reason.alias("reason"))


# --------------------------------------------------------------------- S1
def file_encodings(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(path, encoding)``: UTF-8 when the bytes are valid UTF-8, else latin-1."""
    if not paths:
        return spark.createDataFrame([], "path string, encoding string")
    content = spark.read.format("binaryFile").load(list(paths))
    ok = F.is_valid_utf8(F.col("content").cast("string"))
    return content.select("path", F.when(ok, F.lit("UTF-8")).otherwise(F.lit("ISO-8859-1")).alias("encoding"))


def _split_header(line: F.Column) -> F.Column:
    fields = F.split(F.regexp_replace(line, r"\r$", ""), _SPLIT_OUTSIDE_QUOTES)
    unquote = lambda f: F.regexp_replace(F.regexp_replace(f, r'^\s*"|"\s*$', ""), '""', '"')
    return F.transform(fields, unquote)


def file_headers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(dataset_id, pos, header)`` from the first line of each file.

    Only rows of each file's first split are kept; within a split rows keep
    file order, so the smallest row id is the first line.
    """
    if not paths:
        return spark.createDataFrame([], "dataset_id string, pos int, header string")
    text = (spark.read.text(list(paths))
            .select("value", F.col("_metadata.file_path").alias("dataset_id"),
                    F.col("_metadata.file_block_start").alias("_start"))
            .where(F.col("_start") == 0)
            .withColumn("_id", F.monotonically_increasing_id()))
    first = text.groupBy("dataset_id").agg(F.min_by("value", "_id").alias("line"))
    # A UTF-8 byte-order mark is not part of the first header.
    first = first.withColumn("line", F.regexp_replace("line", "^﻿", ""))
    return first.select("dataset_id", F.posexplode(_split_header(F.col("line"))).alias("pos", "header"))


def _positional_schema(width: int) -> StructType:
    return StructType([StructField(f"_c{i}", StringType()) for i in range(width)]
                      + [StructField("_corrupt_record", StringType())])


def read_csv_group(spark: SparkSession, paths: Sequence[str], width: int, encoding: str = "UTF-8",
                   multiline: bool = True, mode: str = "PERMISSIVE") -> DataFrame:
    """All-string positional read of files that share one header layout.

    The header line of each file is skipped; our own positional names avoid
    the reader renaming repeated headers.  ``multiline`` (the default) keeps
    newlines inside quoted fields, and makes each file one task; without it
    files are split, which is right only for files without such newlines.
    """
    return (spark.read.schema(_positional_schema(width))
            .option("header", True).option("enforceSchema", True)
            .option("encoding", encoding).option("multiLine", multiline)
            .option("quote", '"').option("escape", '"')
            .option("mode", mode).option("columnNameOfCorruptRecord", "_corrupt_record")
            .csv(list(paths))
            .withColumn("dataset_id", F.col("_metadata.file_path")))


def scan_csv(spark: SparkSession, path: str | Sequence[str], encoding: str = "auto",
             multiline: bool = True, max_bytes: int | None = None) -> dict:
    """Plan the read of a CSV folder.

    Returns ``{"files": gate DataFrame, "headers": {dataset_id: [header...]},
    "encodings": {dataset_id: enc}}``; only per-file metadata is collected.
    """
    files = list_files(spark, path, max_bytes=max_bytes)
    accepted = [r.path for r in files.where("accepted AND extension = 'csv'").select("path").collect()]
    if encoding == "auto":
        enc = {r.path: r.encoding for r in file_encodings(spark, accepted).collect()}
    else:
        enc = {p: encoding for p in accepted}
    heads = defaultdict(list)
    for r in file_headers(spark, accepted).orderBy("dataset_id", "pos").collect():
        heads[r.dataset_id].append(r.header)
    return {"files": files, "headers": dict(heads), "encodings": enc, "multiline": multiline}


def read_sales_files(spark: SparkSession, path: str | Sequence[str], encoding: str = "auto",
                     multiline: bool = True, max_bytes: int | None = None,
                     keep_corrupt: bool = False, mode: str = "PERMISSIVE") -> tuple[DataFrame, DataFrame, dict]:
    """Read a CSV folder into canonical text columns.

    Returns ``(raw, mapping, plan)``: ``raw`` has ``dataset_id`` plus every
    canonical column as cleaned text (NULL where the file lacks it) and
    ``_n_columns`` (the file's header width) and ``_other`` (its unmapped columns); ``mapping`` is the
    ``(dataset_id, canonical, pos, header)`` table.  ``mode`` is the CSV
    reader's: PERMISSIVE keeps malformed (e.g. too wide) rows, with the raw
    line in ``_corrupt_record`` when ``keep_corrupt``; FAILFAST raises.
    """
    plan = scan_csv(spark, path, encoding, multiline, max_bytes)
    headers = plan["headers"]
    rows = [(d, i, h) for d, hs in headers.items() for i, h in enumerate(hs)]
    htable = spark.createDataFrame(rows, "dataset_id string, pos int, header string")
    mapping = mapping_table(htable)
    by_file = defaultdict(dict)
    for r in mapping.collect():
        by_file[r.dataset_id][r.canonical] = r.pos
    groups = defaultdict(list)
    for d, hs in headers.items():
        sig = (tuple(hs), tuple(sorted(by_file[d].items())), plan["encodings"].get(d, "UTF-8"))
        groups[sig].append(d)
    parts = []
    for (names, pos_items, enc), paths in groups.items():
        pos, width = dict(pos_items), len(names)
        df = read_csv_group(spark, paths, width, enc, multiline, mode)
        cols = [clean_text(F.col(f"_c{pos[c]}")).alias(c) if c in pos else F.lit(None).cast("string").alias(c)
                for c in CANONICAL]
        extra = [F.col("_corrupt_record")] if keep_corrupt else []
        # Unmapped columns by their header; of equal headers the first.
        rest = {names[i]: i for i in reversed(range(width)) if i not in pos.values()}
        pairs = [x for h, i in sorted(rest.items(), key=lambda r: r[1]) for x in (F.lit(h), clean_text(F.col(f"_c{i}")))]
        other = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        parts.append(df.select("dataset_id", *cols, F.lit(width).alias("_n_columns"), other.alias("_other"), *extra))
    if not parts:
        schema = "dataset_id string, " + ", ".join(f"{c} string" for c in CANONICAL) + ", _n_columns int, _other map<string,string>"
        return spark.createDataFrame([], schema), mapping, plan
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, mapping, plan


# -------------------------------------------------------------------- S10
def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    """First ``rows`` (1..100) rows as JSON records, NULLs kept as null."""
    if not 1 <= rows <= 100:
        raise ValueError("rows must be between 1 and 100")
    return df.limit(rows).select(
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]),
                  {"ignoreNullFields": "false"}).alias("record"))


def preview_summary(df: DataFrame, rows: int = 10) -> DataFrame:
    """One row: total rows, rows previewed, column names and the records."""
    recs = preview(df, rows).agg(F.collect_list("record").alias("data"))   # at most 100 records
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    return total.crossJoin(recs).select(
        "total_rows", F.size("data").alias("preview_rows"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"), "data")


# --------------------------------------------------------------------- S9
def split_digests(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``path, start, digest`` of every split (a byte range of a file, cut at newlines): sha256 of its lines in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([digest.hexdigest()])], ["path", "start", "digest"])

        for b in batches:
            for path, start, value in zip(*(b.column(i).to_pylist() for i in range(3))):
                if (path, start) != now:
                    if now is not None:
                        yield row()
                    now, digest = (path, start), hashlib.sha256()
                digest.update(value)
                digest.update(b"\n")
        if now is not None:
            yield row()

    text = spark.read.option("lineSep", "\n").text(list(paths))
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                       F.col("value").cast("binary").alias("value")).mapInArrow(run, "path string, start long, digest string")


def duplicate_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Files whose bytes equal another file's: ``(md5, path, copies)``; empty files equal each other.

    Only files of a length that occurs again are read, split by split.  Files of one length have the same splits, so
    equal files have equal digests of all splits (``md5`` is that of their list), and of two files of one length and
    equal lines none has a last newline that the other lacks.
    """
    paths = [path] if isinstance(path, str) else list(path)
    listed = list_files(spark, paths, extensions=())
    again = listed.groupBy("length").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    alike = cut_lineage(listed.join(again, "length").select("path", "length"))
    names = [r.path for r in alike.where("length > 0").select("path").collect()]  # names only, as the listing itself
    digests = split_digests(spark, names) if names else spark.createDataFrame([], "path string, start long, digest string")
    whole = digests.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "digest"))).alias("parts"))
    hashed = alike.join(whole, "path", "left").select("path", F.md5(F.concat_ws(
        ",", F.col("length").cast("string"), F.transform(F.coalesce("parts", F.array().cast("array<struct<start:bigint,digest:string>>")),
                                                          lambda x: F.concat_ws(":", x["start"].cast("string"), x["digest"])))).alias("md5"))
    counts = hashed.groupBy("md5").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return hashed.join(counts, "md5")


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows that occur more than once: ``(row_md5, n)``."""
    cols = list(cols or df.columns)
    # Unit separator between fields, record separator for NULL.
    h = F.md5(F.concat_ws("\u001f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u001e"))
                                      for c in cols]))
    return df.groupBy(h.alias("row_md5")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
