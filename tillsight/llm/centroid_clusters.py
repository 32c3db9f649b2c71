"""Centroid clustering over space-filling-curve zone maps.

Vectors are integers, ``floor(1024 x)``.  They are sorted along a Hilbert
curve and cut into blocks of ``BLOCK`` rows; a block is one row of the
block table: its members, the smallest and largest value of every component
(the zone map), its count and its component sums.

A round sends the centroids (a bounded number) to the blocks.  Over a box,
the difference of the distances to two centroids is linear in the vector,
so its largest value is exact from the box's corners: where it is below
zero for a pair, the second centroid cannot win anywhere in the block.
The centroids that no other rules out are the block's candidates.  A block
with one candidate gives its stored sums without a look at its rows;
otherwise its rows are compared with the candidates only, exactly, in int64.
Tasks add up sums per centroid before the shuffle; a round returns one row
per centroid and component to the driver.

Defined results: vectors that are NULL, hold a NULL or non-finite component
or have not exactly ``DIM`` components take no part; integer components
saturate at +-2^27, so squared distances fit a long; ties go to the smaller
centroid; a repeated row is a vector of its own; a NULL id takes part but
is the last choice for a first centroid; rows of one id are chosen in the
order of their components; with fewer vectors than centroids there are
fewer centroids; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

DIM, CENTROIDS, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024
#: Rows of a block, and bits of every component in the Hilbert key.
BLOCK, BITS = 256, 3
#: Components saturate here: 64 squares of differences stay below 2^63.
LARGEST = 1 << 27


def integers(df: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """``vec_id, v`` of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf"))
    d = df.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(
        F.col("x").isNotNull() & (F.size("x") == dim) & F.forall("x", fine))
    whole = lambda y: F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), F.floor(y * float(scale)).cast("double"))).cast("int")
    return d.select("vec_id", F.transform("x", whole).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


# ------------------------------------------------------------- Hilbert order
def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of every row of ``cells`` (unsigned, ``bits`` bits a component) as big-endian bytes, one row each.

    Coordinates become the index's transposed bits by undoing the curve's
    reflections and exchanges from the highest bit down, then a Gray decode.
    """
    x = cells.astype(np.uint32).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q = np.uint32(1 << b)
        low = np.uint32((1 << b) - 1)
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(flip, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    twist = np.zeros(x.shape[1], np.uint32)
    for b in range(bits - 1, 0, -1):
        twist ^= np.where((x[-1] & np.uint32(1 << b)) != 0, np.uint32((1 << b) - 1), np.uint32(0))
    x ^= twist
    planes = np.concatenate([(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)]).astype(np.uint8)
    return np.packbits(planes.T, axis=1)


def _keys(vectors: DataFrame, dim: int) -> DataFrame:
    """Vectors with their Hilbert key; every component's own range (two rows of statistics) sets its cells."""
    ends = vectors.agg(F.array(*[F.min(F.get("v", F.lit(i))) for i in range(dim)]).alias("lo"),
                       F.array(*[F.max(F.get("v", F.lit(i))) for i in range(dim)]).alias("hi")).first()
    low = np.array([x or 0 for x in ends.lo], float)
    span = np.maximum(1.0, np.array([x or 0 for x in ends.hi], float) - low + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = ((_matrix(b.column(1), dim) - low) / span * (1 << BITS)).astype(np.uint32)
            keys = hilbert(cells) if b.num_rows else np.zeros((0, dim * BITS // 8), np.uint8)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([k.tobytes() for k in keys], pa.binary())], ["vec_id", "v", "curve"])

    return vectors.mapInArrow(run, "vec_id long, v array<int>, curve binary")


def blocks(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """The block table: ``n, ids, rows, lo, hi, sums`` in Hilbert order.

    Equal keys may hold any share of the rows; the row number spreads them over partitions.
    """
    keyed = stored(_keys(vectors, dim), "cluster-keys").withColumn("row", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange("curve", "row").sortWithinPartitions("curve", "row").select("vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                v = _matrix(part.column(1), dim).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([len(v)], pa.int32()), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([v.astype(np.int32).tobytes()], pa.binary()),
                    *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in (v.min(axis=0), v.max(axis=0), v.sum(axis=0)))],
                    ["n", "ids", "rows", "lo", "hi", "sums"])

    return stored(ordered.mapInArrow(run, "n int, ids array<long>, rows binary, lo array<long>, hi array<long>, sums array<long>"), "cluster-blocks")


# -------------------------------------------------------------------- rounds
def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which centroids can be nearest to some point of each box: ``boxes x centroids``.

    ``|x - a|^2 - |x - b|^2 = |a|^2 - |b|^2 - 2 x (a - b)``: where its largest value over the box is negative, ``b`` loses
    to ``a``; at zero it does if ``a`` is the smaller number.  Components below 2^27 keep every term in int64.
    """
    k = len(centroids)
    alive = np.ones((len(lo), k), bool)
    squares = centroids * centroids
    for a in range(k):
        step = -2 * (centroids[a] - centroids)  # one row per rival b
        largest = (squares[a] - squares).sum(axis=1) + np.maximum(lo[:, None, :] * step, hi[:, None, :] * step).sum(axis=2)
        alive &= ~((largest < 0) | ((largest == 0) & (np.arange(k) > a)))
    return alive


def assign(v: np.ndarray, centroids: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest of the centroids numbered ``use`` and the squared distance, exact; the first of equals."""
    d = np.stack([((v - centroids[c]) ** 2).sum(axis=1) for c in use], axis=1)
    best = d.argmin(axis=1)
    return use[best], d[np.arange(len(v)), best]


def _members(b: pa.RecordBatch, i: int, dim: int) -> np.ndarray:
    return np.frombuffer(b.column(2)[i].as_py(), np.int32).reshape(-1, dim).astype(np.int64)


def _totals(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``cluster, component, total, n`` over all blocks; every task adds up before the shuffle.

    ``component`` -1 counts blocks settled by their boxes (``n``) of all (``total``).
    """
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        seen = settled = 0
        for b in batches:
            alive = candidates(_matrix(b.column(3), dim), _matrix(b.column(4), dim), centroids) if b.num_rows else np.zeros((0, k), bool)
            whole = _matrix(b.column(5), dim)
            sizes = b.column(0).to_numpy()
            seen += b.num_rows
            for i in range(b.num_rows):
                use = np.flatnonzero(alive[i])
                if len(use) == 1:
                    settled += 1
                    sums[use[0]] += whole[i]
                    count[use[0]] += sizes[i]
                    continue
                v = _members(b, i, dim)
                own, _ = assign(v, centroids, use)
                for c in np.unique(own):
                    sums[c] += v[own == c].sum(axis=0)
                    count[c] += int((own == c).sum())
        held = np.flatnonzero(count)
        cluster = np.concatenate([np.repeat(held, dim), [-1]]).astype(np.int32)
        component = np.concatenate([np.tile(np.arange(dim), len(held)), [-1]]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(component), pa.array(np.concatenate([sums[held].ravel(), [seen]])),
                                          pa.array(np.concatenate([np.repeat(count[held], dim), [settled]]))], ["cluster", "component", "total", "n"])

    parts = table.mapInArrow(run, "cluster int, component int, total long, n long")
    # Sums of longs as decimals: no table is large enough to overflow them.
    return parts.groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors of the smallest hashed ids, in that order."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select("v", hashed.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def next_centroids(table: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, float]:
    """Means, rounded down, of the vectors nearest to each centroid; the share of blocks settled by their boxes."""
    out, share = centroids.copy(), 0.0
    for r in _totals(table, centroids).collect():  # at most k * dim + 1 rows
        if r.cluster >= 0:
            out[r.cluster, r.component] = int(r.total) // r.n
        elif r.total:
            share = r.n / int(r.total)
    return out, share


def cluster(df: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED, report: list | None = None) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector and, by cluster number, the centroids' components as text.

    ``report`` receives the share of blocks that each round settled by their boxes.
    """
    spark = df.sparkSession
    vectors = stored(integers(df, dim), "cluster-vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, centroid array<long>")
    table = blocks(vectors, dim)
    for _ in range(rounds):
        centroids, share = next_centroids(table, centroids)
        if report is not None:
            report.append(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            alive = candidates(_matrix(b.column(3), dim), _matrix(b.column(4), dim), centroids) if b.num_rows else []
            for i in range(b.num_rows):
                own, far = assign(_members(b, i, dim), centroids, np.flatnonzero(alive[i]))
                yield pa.RecordBatch.from_arrays([b.column(1)[i].values, pa.array(own.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    out = table.mapInArrow(run, "vec_id long, cluster int, distance long")
    return out.withColumn("centroid", _by_cluster([F.array(*map(F.lit, c)).cast("array<long>") for c in centroids.tolist()]))


def _by_cluster(values: list[Column]) -> Column:
    return F.get(F.array(*values), F.col("cluster"))


def with_inertia(found: DataFrame, k: int = CENTROIDS) -> DataFrame:
    """``cluster_inertia`` and ``inertia``: distances summed by cluster and over all, from one row per cluster."""
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most k rows
    each = _by_cluster([F.lit(sums.get(c, 0)).cast("long") for c in range(max([k - 1, *sums]) + 1)])
    return found.withColumn("cluster_inertia", each).withColumn("inertia", F.lit(sum(sums.values())).cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: every vector's cluster, distance, inertia and the digest of its centroid."""
    found = stored(cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "cluster-members")
    text = F.concat_ws(",", F.transform("centroid", lambda x: x.cast("string")))
    return with_inertia(found).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(text, 256).alias("centroid_sha256"))


def oracle() -> str:
    """The same in DuckDB: ten rounds written out."""
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"""
a{i} as materialized (
  select r, vec_id, v, arg_min(n, (d, n)) as cluster, min(d) as distance
  from (select k.r, k.vec_id, k.v, c.n, list_sum(list_transform(range(1, {DIM + 1}), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))::bigint as d
        from kept k, c{i} c)
  group by all)""")
        if i < ROUNDS:
            steps.append(f"""
m{i} as (
  select cluster, i, sum(x)::bigint as s, count(*) as m
  from (select cluster, unnest(range(1, {DIM + 1})) as i, unnest(v) as x from a{i}) group by cluster, i),
c{i + 1} as materialized (
  select c.n, coalesce(f.v, c.v) as v
  from c{i} c left join (select cluster, list((s - (((s % m) + m) % m)) // m order by i) as v from m{i} group by cluster) f on f.cluster = c.n)""")
    return f"""
with kept as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
  where embedding is not null and len(embedding) = {DIM}
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
c0 as materialized (
  select row_number() over (order by sha256('{SEED}:' || vec_id) nulls last, v) - 1 as n, v from kept
  qualify n < {CENTROIDS}),{','.join(steps)}
select vec_id, cluster::integer as cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia,
       sum(distance) over ()::bigint as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{ROUNDS} a join c{ROUNDS} c on c.n = a.cluster"""

