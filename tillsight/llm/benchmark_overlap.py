"""Benchmark decontamination by winnowing, in DataFrame operations only.

A window is ``WINDOW`` consecutive words of an item (a shorter item is one
window of its own length).  For windows of ``l`` words, grams of
``k = ceil(l / 2)`` words are hashed and of every ``l - k + 1`` neighbouring
grams the smallest (the first of equals) is kept.  Both sides choose from
the same words, so every shared span of ``l`` words shares its fingerprint:
nothing is missed, at a third of the grams.

1. Documents give fingerprints ``(l, hash, position)``, items give
   ``(l, hash, place of the gram within the window)``.
2. A join on ``(l, hash)`` extends every hit to the span that would be the
   window, and the words of the span decide: its digest is joined with the
   digests of the items' windows.  A hash collision costs a lookup, nothing
   else.
3. Words covered by the spans that remain are counted per document.  Item
   lists are worked out once for each distinct set of windows, not for each
   document, so a passage that very many documents share costs one list.

The fingerprint and digest tables have rows of fixed size.  They are
broadcast if counted to hold at most ``BROADCAST_ROWS`` rows; beyond that
they are copied ``SALTS`` times and joined on a salt too, so that a passage
shared by very many documents is spread over ``SALTS`` tasks.

Defined results: a NULL or empty text has no words (0 words, no hits); equal
rows give equal rows; rows that share an id are judged by their own texts;
rows of ``benchmark`` with equal ids are texts of one item; an item without
an id marks words but is not listed or counted; an empty benchmark hits
nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, stored

WINDOW = 10
#: Rows of a broadcast table (hashes, numbers and digests: under 200 bytes a row in memory) and copies beyond it.
BROADCAST_ROWS, SALTS = 400_000, 32

# What separates words, after A-Z is lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The lower-cased words of a text; none for NULL."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def _gram(length: int) -> tuple[int, int]:
    """Words of a gram and grams of a window of ``length`` words."""
    k = (length + 1) // 2
    return k, length - k + 1


# Hash and position share a long, so that the smallest is the first of the least hash.
_PLACE_BITS = 31
_HASH = lambda x: F.shiftrightunsigned(x, _PLACE_BITS)
_PLACE = lambda x: x.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int")


def chosen(w: Column, length: int) -> Column:
    """The fingerprint (hash and position, packed) of every window of ``length`` words, in their order."""
    k, span = _gram(length)
    packed = lambda i: F.shiftleft(F.xxhash64(F.slice(w, i + 1, k)).bitwiseAND(F.lit(0xFFFFFFFF)), _PLACE_BITS).bitwiseOR(i.cast("long"))
    grams = F.slice(F.transform(w, lambda _, i: packed(i)), F.lit(1), F.size(w) - k + 1)
    least = lambda g: F.slice(F.transform(g, lambda _, i: F.array_min(F.slice(g, i + 1, span))), F.lit(1), F.size(w) - length + 1)
    return F.when(F.size(w) >= length, _let(grams, least) if span > 1 else grams).otherwise(F.array().cast("array<bigint>"))


def fingerprints(w: Column, lengths: list[int]) -> Column:
    """``(l, packed)`` of the distinct fingerprints of a text for each window length."""
    def of(n: int) -> Column:
        return F.transform(F.array_distinct(chosen(w, n)), lambda x: F.struct(F.lit(n).alias("l"), x.alias("packed")))

    return F.concat(*map(of, lengths))


def _span(w: Column, begin: Column, length: Column) -> Column:
    """Digest of the words from ``begin`` (from 0) on; words hold no spaces, so different spans are different texts."""
    return F.unhex(F.sha2(F.concat_ws(" ", F.slice(w, begin + 1, length)), 256))


# -------------------------------------------------------------------- items
def _windows_of(w: Column, length: int) -> Column:
    return F.transform(chosen(w, length), lambda x, i: F.struct(
        _HASH(x).alias("hash"), (_PLACE(x) - i).alias("place"), _span(w, i, F.lit(length)).alias("digest")))


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``l, hash, place, digest, item_id`` of every window of every item."""
    d = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    d = d.select("item_id", "w", F.least(F.size("w"), F.lit(window)).alias("l"))
    each = F.lit(None)
    for n in range(1, window + 1):
        each = F.when(F.col("l") == n, _windows_of(F.col("w"), n)).otherwise(each)
    return d.select("item_id", "l", F.explode(each).alias("x")).select("item_id", "l", "x.hash", "x.place", "x.digest")


def _meet(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, limit: int) -> DataFrame:
    """Inner join with a table of small rows: broadcast if counted to be small, else salted by ``spread``."""
    if right.limit(limit + 1).count() <= limit:
        return left.join(F.broadcast(right), keys)
    copies = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("salt", F.pmod(spread, F.lit(SALTS)).cast("int")).join(copies, [*keys, "salt"]).drop("salt")


# ---------------------------------------------------------------- documents
def overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id, n_words, n_hit, item_ids, contaminated`` for every row of ``docs``.

    ``item_ids`` holds the items with a window in the document, sorted as strings.
    """
    table = stored(windows(items, window), "benchmark-windows")
    lengths = sorted(r.l for r in table.select("l").distinct().collect())  # at most ``window`` values
    d = documents(docs)
    # Rows of one id and text are one text: they share a key and its result.
    key = F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))), 256))
    d = d.select("doc_id", key.alias("key"), words(F.col("text")).alias("w"))
    prints = fingerprints(F.col("w"), lengths) if lengths else F.array().cast("array<struct<l:int,packed:bigint>>")
    marked = stored(d.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), prints.alias("prints")), "document-prints")

    # Every fingerprint that an item has too stands for the span that would be the window.
    seen = marked.select("key", "n_words", F.explode("prints").alias("p")).select(
        "key", "n_words", "p.l", _HASH(F.col("p.packed")).alias("hash"), _PLACE(F.col("p.packed")).alias("at"))
    places = stored(table.select("l", "hash", "place").distinct(), "benchmark-prints")
    found = _meet(seen, places, ["l", "hash"], F.xxhash64("key", "at"), limit)
    begin = F.col("at") - F.col("place")
    found = found.where((begin >= 0) & (begin + F.col("l") <= F.col("n_words")))
    spans = stored(found.groupBy("key").agg(F.collect_set(F.struct("l", begin.alias("begin"))).alias("spans")), "document-spans")

    # The words decide: only documents with such a span are read again.
    texts = documents(docs).select(key.alias("key"), "text")
    if spans.limit(limit + 1).count() <= limit:  # keys are 32 bytes; beyond the limit the texts are shuffled once
        texts = texts.join(F.broadcast(spans.select("key")), "key", "left_semi")
    texts = texts.dropDuplicates(["key"]).join(spans, "key")
    texts = texts.select("key", "spans", words(F.col("text")).alias("w"))
    # Digests are an array first: exploding beside the words would copy them into every row.
    read = F.transform("spans", lambda s: F.struct(s["l"].alias("l"), s["begin"].alias("begin"), _span(F.col("w"), s["begin"], s["l"]).alias("digest")))
    read = texts.select("key", read.alias("read")).select("key", F.explode("read").alias("r")).select("key", "r.*")
    classes = stored(_classes(table), "benchmark-classes")
    hits = _meet(read, classes.select("digest", "class"), ["digest"], F.xxhash64("key", "begin"), limit)
    ends = F.array_sort(F.collect_set(F.struct("begin", (F.col("begin") + F.col("l")).alias("end"))))
    covered = F.aggregate(ends, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda s, x: F.struct(
        F.greatest(s["end"], x["end"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["end"], x["begin"]))).alias("n")),
        lambda s: s["n"])
    hits = hits.groupBy("key").agg(covered.alias("n_hit"), F.array_sort(F.collect_set("class")).alias("classes"))
    hits = stored(hits.withColumn("set", F.unhex(F.sha2(F.concat_ws(",", F.transform("classes", lambda x: F.hex(x))), 256))), "document-hits")
    lists = _lists(hits, table)

    one = hits.select("key", "n_hit", "set").join(lists, "set", "left").drop("set")
    out = marked.select("doc_id", "key", "n_words").join(one, "key", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
                      F.col("n_hit").isNotNull().alias("contaminated"))


def _classes(table: DataFrame) -> DataFrame:
    """``digest, class``: windows of the same items share a class, named by their list of items."""
    owners = table.where(F.col("item_id").isNotNull()).select("digest", "item_id").distinct()
    named = owners.groupBy("digest").agg(F.unhex(F.sha2(F.to_json(F.array_sort(F.collect_list("item_id"))), 256)).alias("class"))
    return table.select("digest").distinct().join(named, "digest", "left").select("digest", F.coalesce("class", F.lit(b"")).alias("class"))


def _lists(hits: DataFrame, table: DataFrame) -> DataFrame:
    """``set, item_ids`` for every distinct set of classes that some document holds."""
    sets = hits.select("set", "classes").dropDuplicates(["set"]).select("set", F.explode("classes").alias("class"))
    owners = _classes(table).groupBy("class").agg(F.min("digest").alias("digest"))  # one window speaks for its class
    members = owners.join(table.where(F.col("item_id").isNotNull()).select("digest", "item_id").distinct(), "digest").select("class", "item_id")
    return sets.join(members, "class").groupBy("set").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: one row per document, the items as the digest of their sorted ids."""
    out = overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


def oracle() -> str:
    """The same in DuckDB without fingerprints: every window of every document by its words."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    return rf"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all({low}, '{word}') as w from documents),
i as (
  select item_id::varchar as item_id, w, least(len(w), {WINDOW}) as l
  from (select item_id, regexp_extract_all({low}, '{word}') as w from benchmark) where len(w) > 0),
iw as (
  select distinct item_id, l, array_to_string(w[b:b + l - 1], ' ') as t
  from (select item_id, w, l, unnest(range(1, len(w) - l + 2)) as b from i)),
lengths as (select distinct l from i),
dw as (
  select r, l, b, array_to_string(w[b:b + l - 1], ' ') as t
  from (select r, w, l, unnest(range(1, len(w) - l + 2)) as b from d, lengths where len(w) >= l)),
hit as (select r, b, l, dw.t from dw semi join iw on iw.l = dw.l and iw.t = dw.t),
covered as (select r, count(distinct p) as n_hit from (select r, unnest(range(b, b + l)) as p from hit) group by r),
owned as (
  select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct r, item_id from hit h join iw on iw.l = h.l and iw.t = h.t where item_id is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (r) left join owned using (r)"""
