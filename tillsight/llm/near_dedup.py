"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

Sketch (fast similarity sketching): a set's elements are thrown into ``t``
bins in rounds.  In round ``i < t`` an element falls into a random bin, in
round ``t + i`` all elements fall into bin ``i``; a bin keeps the smallest
``(round, hash)`` seen.  Rounds stop once every bin has a value, so each
coordinate is filled, also for sets of one element, in ``O(n + t log t)``
expected time, and the share of equal coordinates estimates the similarity
with the same concentration as ``t`` independent hash functions.

Banding: ``bands`` groups of ``rows`` coordinates.  With the defaults (40
bands of 5) a pair at similarity 0.8 shares no band with probability 1.3e-7.

Links: equal sets are one set, known by its digest and numbered for the joins; its
smallest id is carried along.  In each bucket the
members are compared with two pivots, the smallest number and the member that
shares most buckets (of edited copies, the original); the components so found
are merged.  Documents of buckets that still reach into several components
are then joined exactly, by prefix and positional filtering: with shingles
ordered from rare to frequent, the first shingle that similar sets share must
leave enough of both sets behind it, and only shingles that reach into
several components pair anything.  So hot buckets of copies cost a star, not all pairs, and no
link that joins components is lost.  Every link is confirmed on full sets.

Defined results: texts without words are linked with nothing; a row without
``doc_id`` takes no part, has no component and is kept; rows that repeat a
``doc_id`` are judged one by one, by their own sets; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, mix, release, rows_of, stored, word_hashes, words

BANDS, ROWS, SHINGLE = 40, 5, 2
#: Ids of candidates are broadcast up to this many rows (16 MB), else joined by a shuffle.
BROADCAST_IDS = 2_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


# ------------------------------------------------------------------ sets, sketches
def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``k``-word shingle hashes of each text, sorted: ``(hashes, offsets)``.

    Words are lower-cased (A-Z); a text of fewer words has one shingle, the
    whole; one without words has none.
    """
    starts, ends, first = words(data, offsets)
    h = word_hashes(data, starts, ends)
    n = np.diff(first)
    with np.errstate(over="ignore"):
        whole = h.copy()
        for i in range(1, k):
            nxt = np.concatenate([h[i:], np.zeros(min(i, len(h)), np.uint64)])
            whole = mix(whole * _GOLD + nxt + np.uint64(i))
    sets = []
    for begin, m in zip(first[:-1].tolist(), n.tolist()):
        if m >= k:
            sets.append(_distinct(whole[begin:begin + m - k + 1]))
        elif m:
            value = np.uint64(m)
            for x in h[begin:begin + m]:
                value = mix(np.array([value]) * _GOLD + x)[0]
            sets.append(np.array([value], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def sketches(hashes: np.ndarray, offsets: np.ndarray, t: int) -> np.ndarray:
    """The ``t`` coordinates of every set (rows; an empty set's are all ones)."""
    n = np.diff(offsets)
    full = np.full((len(n), t), ~np.uint64(0))
    flat = full.reshape(-1)
    open_sets = np.flatnonzero(n)
    elements, owner = hashes, np.repeat(np.arange(len(n)), n)
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            if not len(open_sets):
                break
            x = mix(elements + np.uint64(i + 1) * _GOLD)
            # The round leads the value, so an earlier round's value always wins.
            value = (np.uint64(i) << np.uint64(48)) | (x >> np.uint64(16))
            if i < t:
                place = ((x & np.uint64(0xFFFF)) * np.uint64(t) >> np.uint64(16)).astype(np.int64)
                np.minimum.at(flat, owner * t + place, value)
            else:
                np.minimum.at(flat, owner * t + (i - t), value)
            still = (full[open_sets] == ~np.uint64(0)).any(axis=1)
            if not still.all():
                lacking = np.zeros(len(n), bool)
                open_sets = open_sets[still]
                lacking[open_sets] = True
                keep = lacking[owner]
                elements, owner = elements[keep], owner[keep]
    return full


def band_keys(full: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, (len(full), bands)).copy()
        parts = full[:, :bands * rows].reshape(len(full), bands, rows)
        for r in range(rows):
            key = mix(key * _GOLD + parts[:, :, r])
    return key.view(np.int64)


def signatures(df: DataFrame, bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, digest`` (of the whole set) and ``bands`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, end, data, offsets in rows_of(b):
                hashes, at = shingle_sets(data, offsets, k)
                keys = band_keys(sketches(hashes, at, bands * rows), bands, rows)
                digests = [hashlib.blake2b(hashes[i:j].tobytes(), digest_size=16).digest() for i, j in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(row, end - row), pa.array(np.diff(at)), pa.array(digests, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * bands, pa.int32()), pa.array(keys.ravel()))],
                    ["doc_id", "n_shingles", "digest", "bands"])
        release()

    return documents(df).mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def full_sets(df: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``doc_id, digest, hashes`` (sorted 64-bit shingle hashes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, end, data, offsets in rows_of(b):
                hashes, at = shingle_sets(data, offsets, k)
                sets = [hashes[i:j].tobytes() for i, j in zip(at[:-1], at[1:])]
                digests = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, end - row), pa.array(digests, pa.binary()), pa.array(sets, pa.binary())],
                                                 ["doc_id", "digest", "hashes"])
        release()

    return documents(df).mapInArrow(run, "doc_id long, digest binary, hashes binary")


# ------------------------------------------------------------------ verification
def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs(a, b)`` with ``linked``: 100 * intersection >= percent * union, on full sets."""
    left = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("hb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                z = np.sort(np.concatenate([x, y]), kind="stable")
                both = int((z[1:] == z[:-1]).sum())
                linked.append(100 * both >= percent * (len(z) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long, linked boolean")


def _prefix_pairs(open_sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of ``open_sets(rep, root, hashes)`` from different roots that can be similar: they share a prefix shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(2)]
                n = np.array([len(x) for x in sets])
                which = pa.array(np.repeat(np.arange(len(sets)), n))
                yield pa.RecordBatch.from_arrays([part.column(0).take(which), part.column(1).take(which), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets))],
                                                 ["rep", "root", "n", "h"])

    every = open_sets.select("rep", "root", "hashes").mapInArrow(run, "rep long, root long, n long, h long")
    # A shingle of one document pairs nothing, but takes its place at the head of the prefix.
    shared = every.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    of_doc = Window.partitionBy("rep")
    ranked = every.join(shared, "h").withColumn("rank", F.row_number().over(of_doc.orderBy("df", "h"))).withColumn("m", F.count(F.lit(1)).over(of_doc))
    ranked = ranked.withColumn("left", F.col("m") - F.col("rank") + 1)  # shingles from this one on
    prefix = stored(ranked.where(100 * F.col("left") >= percent * F.col("n")).select("h", "rep", "root", "n", "left"), "prefixes")
    across = prefix.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("h")
    x = prefix.join(across, "h")
    y = x.select(F.col("h").alias("h2"), F.col("rep").alias("rep2"), F.col("root").alias("root2"), F.col("n").alias("n2"), F.col("left").alias("left2"))
    # The first shared shingle of a similar pair leaves room for an intersection of percent / (100 + percent) of both sizes.
    room = (100 + percent) * F.least("left", "left2") >= percent * (F.col("n") + F.col("n2"))
    pairs = x.join(y, (x.h == y.h2) & (F.col("root") < F.col("root2")) & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")) & room)
    return pairs.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct()


# -------------------------------------------------------------------- components
def components(links: DataFrame) -> DataFrame:
    """``(rep, root)`` for every end of ``links(a, b)``: the smallest number reachable.

    Alternates large-star and small-star steps, each a grouped minimum and a
    join, until the edges are a star around each root.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges, before = stored(edges, "edges"), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("rep"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("rep"), F.col("v").alias("root")).distinct())
        before = state
        # Large star: larger neighbours of u move to u's smallest neighbour (or u).
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # Small star: smaller neighbours of u, and u, move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stored(small.select("e.u", "e.v").where("u > v").distinct(), "edges")


# -------------------------------------------------------------------- the operator
def judged(df: DataFrame, percent: int = 80, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, digest, root, component_id`` of every row; ``root`` is the component's number, NULL for a row that takes no part."""
    marks = stored(signatures(df, bands, rows, k), "signatures")
    usable = marks.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # One number for each distinct set, fixed as it is written (a doc_id may have several sets); equal sets have equal bands.
    reps = stored(usable.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
                  .withColumn("rep", F.monotonically_increasing_id()), "sets")
    spread = reps.select("rep", "n", F.explode("bands").alias("bucket"))
    crowded = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stored(spread.join(crowded, "bucket").select("bucket", "rep", "n", "size"), "buckets")
    weights = members.groupBy("rep").agg(F.sum("size").alias("weight"))
    members = members.join(weights, "rep")
    pivots = members.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("least"), F.max(F.struct("weight", (-F.col("rep")).alias("rep"), "n")).alias("hub"))

    def near(x: Column, y: Column) -> Column:  # sizes that similarity allows
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    pivots = pivots.select("bucket", F.explode(F.array(F.struct(F.col("least.rep").alias("rep"), F.col("least.n").alias("n")),
                                                       F.struct((-F.col("hub.rep")).alias("rep"), F.col("hub.n").alias("n")))).alias("p"))
    first = members.join(pivots, "bucket").where((F.col("p.rep") != F.col("rep")) & near(F.col("p.n"), F.col("n")))
    pairs = stored(first.select(F.least("p.rep", "rep").alias("a"), F.greatest("p.rep", "rep").alias("b")).distinct(), "pairs")
    # Full sets of the documents in crowded buckets only.  A doc_id has many rows if it repeats; the digest tells which.
    wanted = members.select("rep").distinct().join(reps.select("rep", F.col("least").alias("doc_id"), "digest"), "rep")
    wanted = stored(wanted, "candidates")
    hint = F.broadcast if wanted.count() <= BROADCAST_IDS else lambda x: x
    source = documents(df).join(hint(wanted.select("doc_id")), "doc_id", "left_semi")
    sets = stored(full_sets(source, k).join(hint(wanted), ["doc_id", "digest"])
                  .select("rep", "hashes").dropDuplicates(["rep"]), "full-sets")

    checked = stored(_verified(pairs, sets, percent), "links")
    roots = stored(components(checked.where("linked")), "roots")
    # Documents of buckets that reach into more than one component; the others are settled.
    placed = members.where("size > 2").join(roots, "rep", "left").select("bucket", "rep", F.coalesce("root", "rep").alias("root"))
    split = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
    open_ = stored(placed.join(split, "bucket").select("rep", "root").distinct(), "open")
    new = _prefix_pairs(open_.join(sets, "rep"), percent).join(checked.select("a", "b"), ["a", "b"], "left_anti")
    found = stored(_verified(new, sets, percent), "links")
    # Components are merged by the links between their roots; nothing else is touched.
    bridges = (found.where("linked").join(open_.select(F.col("rep").alias("a"), F.col("root").alias("ra")), "a")
               .join(open_.select(F.col("rep").alias("b"), F.col("root").alias("rb")), "b"))
    merged = components(bridges.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("root").alias("new"), F.col("rep").alias("root"))
    roots = roots.unionByName(open_).distinct().join(merged, "root", "left").select("rep", F.coalesce("new", "root").alias("root"))

    placed = reps.select("digest", "rep", "least").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    # The component's id is its smallest doc_id; its number need not be that one's.
    lowest = reps.select("rep", "least").join(roots, "rep").groupBy("root").agg(F.min("least").alias("lowest"))
    by_set = placed.join(lowest, "root", "left").select("digest", "root", F.coalesce("lowest", "least").alias("component_id"))
    with_set = marks.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest"))
    out = with_set.join(by_set, "digest", "left")
    takes_part = F.col("doc_id").isNotNull()
    return out.select("doc_id", "n_shingles", "digest", F.when(takes_part, F.col("root")).alias("root"),
                      F.when(takes_part, F.coalesce("component_id", "doc_id")).alias("component_id"))


def near_duplicates(df: DataFrame, percent: int = 80, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``df(doc_id, text)``."""
    return judged(df, percent, k, bands, rows).select("doc_id", "n_shingles", "component_id").withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def distinct_rows(df: DataFrame, k: int = SHINGLE) -> DataFrame:
    """One row of each component, of its smallest ``doc_id``, and every row that takes no part; the columns of ``df``.

    Sets are of ``k``-word shingles.
    """
    rows = stored(judged(df, k=k), "judged")
    many = stored(rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated")
    # Ids of one row are settled by the id alone.
    gone = stored(rows.where("component_id <> doc_id").select("doc_id").distinct().unionByName(many).distinct(), "duplicates")
    hint = F.broadcast if gone.count() <= BROADCAST_IDS else lambda x: x
    once = df.join(hint(gone), "doc_id", "left_anti").select(df.columns)
    if many.isEmpty():
        return once
    again = df.join(many, "doc_id", "left_semi")
    numbered = again.withColumn("_texts", F.struct(*df.columns)).groupBy("_texts").agg(F.count(F.lit(1)).alias("_copies"))
    numbered = stored(numbered.select("_texts", "_copies", F.monotonically_increasing_id().alias("_row")), "repeated-rows")
    # Each different row with the digest of its set; a component's row is the first by digest and content.
    sets = signatures(numbered.select(F.col("_row").alias("doc_id"), F.col("_texts.text").alias("text")), k=k).select(F.col("doc_id").alias("_row"), F.col("digest").alias("_digest"), F.col("n_shingles").alias("_n"))
    found = numbered.join(sets, "_row").withColumn("_doc", F.col("_texts.doc_id").cast("long"))
    chosen = rows.where("doc_id = component_id AND root IS NOT NULL").groupBy("root", "doc_id").agg(F.min("digest").alias("_digest"))
    chosen = chosen.join(many, "doc_id", "left_semi").select(F.col("doc_id").alias("_doc"), "_digest")
    first = found.where("_n > 0").join(chosen, ["_doc", "_digest"]).groupBy("_doc", "_digest").agg(F.min("_texts").alias("_texts"))
    none = found.where("_n = 0").select(F.explode(F.array_repeat("_texts", F.col("_copies").cast("int"))).alias("_texts"))
    return once.unionByName(first.select("_texts.*").unionByName(none.select("_texts.*")))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: one row per document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """The same in DuckDB: all pairs by shared shingles, components by recursion."""
    return r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (
  select doc_id, case when len(w) = 0 then [] when len(w) = 1 then w
         else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from w),
e as (select doc_id, len(s) as n, unnest(s) as x from s),
c as (
  select a.doc_id as a, b.doc_id as b, count(*) as k, any_value(a.n) as n, any_value(b.n) as m
  from e a join e b on a.x = b.x and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by all),
l as (select a, b from c where 100 * k >= 80 * (n + m - k)),
g as (select a as u, b as v from l union all select b, a from l),
r as (select doc_id as u, doc_id as root from s union select r.u, g.v from r join g on r.root = g.u),
m as (select u, min(root) as component_id from r group by u)
select s.doc_id, len(s)::bigint as n_shingles, component_id, s.doc_id = component_id as kept from s join m on s.doc_id = m.u"""
