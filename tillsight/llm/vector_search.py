"""Exact top-k inner-product search: an M-tree of paged metric nodes, searched best first.

Vectors are integers, ``floor(1024 x)``.  Adding the coordinate
``sqrt(M - |v|^2)`` (M: the largest squared norm) to rows and 0 to queries
makes the largest inner product the smallest Euclidean distance:
``d^2 = |q|^2 + M - 2 q.v``, so the tree is a metric one and the search exact.

Tree: the root holds routing objects (a bounded sample of rows); each has
pages of bounded size, and a page's leaf nodes hold a routing object, a
covering radius and every entry's distance to it.  A page is one row of the
index table.  Search: a query first visits its nearest routing object's
pages, which bounds its k-th distance; it is then sent only to the routing
objects whose ball reaches within that bound.  Inside a page, leaves are
visited in the order of their smallest possible distance until that exceeds
the bound, and entries are skipped, without a distance computed, when the
stored distances rule them out by the triangle inequality.

Defined results: rows whose id or vector is NULL, or whose vector holds a
NULL or non-finite component or none at all, take no part; vectors are
compared within their dimension only; rows of a query's own id are its own;
ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Routing objects of the root: drawn from at most SAMPLE rows, at most ROUTES of them, about one for PAGE rows.
SAMPLE, ROUTES, PAGE, LEAF = 4_096, 256, 2_048, 64
#: Queries that meet a page together.
BLOCK = 2_048
SCALE = 1024


def integers(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, dim, v`` of the rows that take part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    x = F.col("embedding").cast("array<double>")
    d = df.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    d = d.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", fine))
    return d.select("vec_id", F.size("x").alias("dim"), F.transform("x", lambda y: F.floor(F.lit(float(scale)) * y).cast("long")).alias("v"))


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _lift(v: np.ndarray, m: int) -> np.ndarray:
    """Rows with the coordinate that makes all norms equal."""
    v = v.astype(float)
    return np.column_stack([v, np.sqrt(np.maximum(0.0, m - (v * v).sum(axis=1)))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)))


def routes(rows: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first choice of ``n`` rows."""
    chosen = [0]
    d = _distances(rows, rows[:1])[:, 0]
    while len(chosen) < min(n, len(rows)) and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, _distances(rows, rows[chosen[-1:]])[:, 0])
    return rows[chosen]


def _slack(d):
    """Room for rounding in float64 distances."""
    return 1e-6 * (1 + d)


# ----------------------------------------------------------------------- index
def build(vectors: DataFrame, seed: int = 7):
    """The page table and the root: ``(pages, {dim: routing objects}, {dim: radii}, M)``."""
    norms = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    stats = vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(norms).alias("m")).orderBy(F.desc("n"), "dim").limit(64).collect()
    total, biggest = sum(r.n for r in stats), vectors.agg(F.max(norms)).first()[0] or 0
    drawn = vectors.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(SAMPLE).collect() if total else []
    root = {}
    for r in stats:
        own = np.array([x.v for x in drawn if x.dim == r.dim], float)
        if len(own):
            root[r.dim] = routes(_lift(own, biggest), max(1, min(ROUTES, round(r.n / PAGE))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                if dim in root:
                    d = _distances(_lift(_matrix(part.column(2), dim), biggest), root[dim])
                    near = d.argmin(axis=1)
                    far = d[np.arange(len(near)), near]
                else:  # a dimension without routing objects: one region without bounds
                    near, far = np.full(part.num_rows, -1), np.full(part.num_rows, np.inf)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32)), pa.array(far)], ["vec_id", "dim", "v", "route", "away"])

    placed = stored(vectors.mapInArrow(assign, "vec_id long, dim int, v array<long>, route int, away double"), "vectors-placed")
    balls = placed.groupBy("dim", "route").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
    # At most ROUTES rows for each of the dimensions that have routing objects.
    radii = {}
    for r in balls.where("route >= 0").collect():
        radii.setdefault(r.dim, np.full(len(root[r.dim]), -np.inf))[r.route] = r.radius
    sizes = balls.select("dim", "route", F.ceil(F.col("n") / PAGE).cast("int").alias("pages"))
    salted = placed.join(sizes, ["dim", "route"]).withColumn("page", F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col("pages")).cast("int"))

    def node(key, table):
        dim = key[0].as_py()
        table = table.sort_by("vec_id")
        v = _matrix(table.column("v"), dim)
        x = _lift(v, biggest)
        centres = routes(x, max(1, len(x) // LEAF))
        d = _distances(x, centres)
        leaf = d.argmin(axis=1)
        away = d[np.arange(len(leaf)), leaf]
        order = np.lexsort((away, leaf))
        count = np.bincount(leaf, minlength=len(centres))
        radius = np.array([away[leaf == i].max() if count[i] else -1.0 for i in range(len(centres))])
        return pa.table({
            "dim": [dim], "route": [key[1].as_py()], "page": [key[2].as_py()], "ids": [table.column("vec_id").to_numpy()[order].tobytes()],
            "rows": [v[order].astype(np.int64).tobytes()], "away": [away[order].tobytes()], "leaf_sizes": [count.astype(np.int64).tobytes()],
            "centres": [centres.tobytes()], "radii": [radius.tobytes()]}, schema=pa.schema([
                ("dim", pa.int32()), ("route", pa.int32()), ("page", pa.int32()), *((k, pa.binary()) for k in ("ids", "rows", "away", "leaf_sizes", "centres", "radii"))]))

    pages = salted.select("dim", "route", "page", "vec_id", "v").groupBy("dim", "route", "page").applyInArrow(
        node, "dim int, route int, page int, ids binary, rows binary, away binary, leaf_sizes binary, centres binary, radii binary")
    return stored(pages, "vector-pages"), root, radii, int(biggest)


# ---------------------------------------------------------------------- search
class Page:
    """A page's leaf nodes in memory."""

    def __init__(self, row: dict, m: int):
        self.dim, self.m = row["dim"], m
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.rows = np.frombuffer(row["rows"], np.int64).reshape(-1, self.dim)
        self.away = np.frombuffer(row["away"], float)
        self.ends = np.cumsum(np.frombuffer(row["leaf_sizes"], np.int64))
        self.centres = np.frombuffer(row["centres"], float).reshape(-1, self.dim + 1)
        self.radii = np.frombuffer(row["radii"], float)
        # Products are exact in floats while squared norms are.
        self.exact = self.rows.astype(float) if m < 1 << 52 else self.rows

    def search(self, query_id: int, q: np.ndarray, to_centres: np.ndarray, k: int, bound: float) -> tuple[list[int], list[int]]:
        """Ids and scores of the page's best ``k`` rows within distance ``bound`` of a query."""
        square = float((q.astype(float) ** 2).sum()) + self.m
        best: list[tuple[int, int]] = []  # (score, -id): the worst first
        least = np.maximum(0.0, to_centres - self.radii)
        for leaf in np.argsort(least, kind="stable").tolist():
            if least[leaf] > bound + _slack(bound):
                break
            begin, end = int(self.ends[leaf - 1]) if leaf else 0, int(self.ends[leaf])
            # Entries are sorted by their distance to the routing object: a slice can lie within the bound.
            room = bound + _slack(bound)
            if np.isfinite(room):
                near = self.away[begin:end]
                begin, end = (begin + int(np.searchsorted(near, to_centres[leaf] - room, "left")),
                              begin + int(np.searchsorted(near, to_centres[leaf] + room, "right")))
            if end <= begin:
                continue
            scores = (self.exact[begin:end] @ (q.astype(float) if self.exact.dtype == float else q)).astype(np.int64)
            pick = np.flatnonzero(self.ids[begin:end] != query_id)
            if len(best) == k:
                pick = pick[scores[pick] >= best[0][0]]
            elif len(pick) > 4 * k:
                cut = np.partition(scores[pick], len(pick) - k)[len(pick) - k]
                pick = pick[scores[pick] >= cut]
            for i in pick.tolist():
                row = int(self.ids[begin + i])
                item = (int(scores[i]), -row)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                bound = min(bound, float(np.sqrt(max(0.0, square - 2.0 * best[0][0]))))
        best.sort(reverse=True)
        return [-i for _, i in best], [s for s, _ in best]


def _visit(pages: DataFrame, queries: DataFrame, m: int, k: int) -> DataFrame:
    """The best ``k`` of each page for the queries ``(query_id, q, dim, route, block, bound)`` sent to its region."""
    schema = "query_id long, vec_id long, score long, square double"

    def run(left, right):
        out = {"query_id": [], "vec_id": [], "score": [], "square": []}
        if left.num_rows and right.num_rows:
            ids, bounds = right.column("query_id").to_pylist(), right.column("bound").to_pylist()
            for row in left.select(["dim", "ids", "rows", "away", "leaf_sizes", "centres", "radii"]).to_pylist():
                page = Page(row, m)
                q = _matrix(right.column("q"), page.dim)
                to_centres = _distances(np.column_stack([q.astype(float), np.zeros(len(q))]), page.centres)
                for i, (query_id, bound) in enumerate(zip(ids, bounds)):
                    found, scores = page.search(query_id, q[i], to_centres[i], k, bound)
                    out["query_id"] += [query_id] * len(found)
                    out["vec_id"] += found
                    out["score"] += scores
                    out["square"] += [float((q[i].astype(float) ** 2).sum())] * len(found)
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("square", pa.float64())]))

    # A page meets the queries block by block: neither side of a group grows with the data.
    queries = stored(queries, "routed")
    blocks = queries.select("dim", "route", "block").distinct()
    left = pages.join(blocks, ["dim", "route"])
    at = pages.select(F.col("dim").alias("of_dim"), F.col("route").alias("of_route"), F.col("page").alias("of_page"))
    right = queries.withColumnsRenamed({"dim": "of_dim", "route": "of_route", "block": "of_block"}).join(at, ["of_dim", "of_route"])
    right = right.select("of_dim", "of_route", "of_block", "of_page", "query_id", "q", "bound")
    return left.groupBy("dim", "route", "block", "page").cogroup(right.groupBy("of_dim", "of_route", "of_block", "of_page")).applyInArrow(run, schema)


def top_k(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows for every row that ``is_query`` holds for."""
    vectors = stored(vectors, "vectors")
    pages, root, radii, m = build(vectors)
    wanted = vectors.where(is_query)
    n_queries = wanted.count()
    blocks = max(1, -(-n_queries // BLOCK))
    schema = "query_id long, q array<long>, dim int, route int, block int, bound double"

    def send(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                dims, bound = b.column(2).to_numpy(), b.column(4).to_numpy()
                for dim in np.unique(dims).tolist():
                    use = dims == dim
                    part, limit = b.filter(pa.array(use)), bound[use]
                    if dim in root:
                        q = _matrix(part.column(1), dim).astype(float)
                        d = _distances(np.column_stack([q, np.zeros(len(q))]), root[dim])
                        d[:, ~np.isfinite(radii[dim])] = np.inf
                        home = d.argmin(axis=1)
                        if first:
                            i, j = np.arange(len(q)), home
                        else:
                            reach = (d - radii[dim] <= (limit + _slack(limit))[:, None]) & np.isfinite(d)
                            reach[np.arange(len(q)), home] = False
                            i, j = np.nonzero(reach)
                    else:
                        i, j = (np.arange(part.num_rows), np.full(part.num_rows, -1)) if first else (np.zeros(0, int), np.zeros(0, int))
                    sent = part.take(pa.array(i))
                    yield pa.RecordBatch.from_arrays([sent.column(0), sent.column(1), sent.column(2), pa.array(j.astype(np.int32)), sent.column(3), sent.column(4)],
                                                     ["query_id", "q", "dim", "route", "block", "bound"])
        return run

    queries = wanted.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "dim", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    queries = queries.withColumn("bound", F.lit(float("inf")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def leading(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    home = stored(leading(_visit(pages, queries.mapInArrow(send(True), schema), m, k).distinct()), "home-results")
    # The k-th best so far bounds the distance of all that can still matter.
    bounds = home.where(F.col("rank") == k).select("query_id", F.sqrt(F.greatest(F.lit(0.0), F.col("square") + m - 2 * F.col("score"))).alias("bound"))
    later = queries.drop("bound").join(bounds, "query_id", "left").select("query_id", "q", "dim", "block", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    rest = _visit(pages, later.mapInArrow(send(False), schema), m, k)
    found = leading(home.drop("rank").unionByName(rest).select("query_id", "vec_id", "score").distinct())
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: rows whose id is divisible by 100, against all rows."""
    return top_k(integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), F.col("vec_id") % 100 == 0)


def oracle() -> str:
    return """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 100 = 0)
select query_id, rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s) where rank <= 10"""
