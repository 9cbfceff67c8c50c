"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors are scaled by the greatest norm and given one more component that makes them unit vectors, which turns the
largest inner product into the least distance. A table cuts ``projections`` random Gaussian (2-stable) projections into
cells of ``width``; a vector's bucket is its tuple of cells. A near neighbour's projection is normal around the closeness
times the query's own, so each bucket has a chance of holding it, the product over projections. Each query visits
buckets in the order of that chance, best first and exactly, until the chances add up to ``success``, which is raised until the sample's own neighbours
are found as often as is asked; several tables miss independently. Candidates of all tables are merged, scored exactly in double precision on the original vectors and
ranked.

Buckets and their probes are dealt into blocks of at most BLOCK vectors and BLOCK queries, on average, so a
bucket that holds a third of all vectors is many tasks' work. Per block only each query's best go on. Queries that got fewer than they
should, as there are few vectors or their buckets are nearly empty, and those whose buckets would be too many to name, are held against all vectors, in blocks.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, as queries or
candidates. Vectors of different lengths have no product: each length is searched by itself. Rows with a null id take no part. Rows that repeat an id are one
candidate: the one with the larger score. Equal scores rank by smaller id. Other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyway.llm.tables import cut

#: Vectors and queries of a block.
BLOCK = 4096
#: Buckets that are drawn up for a query first, and at most; a query that needs more in a table is held against all vectors.
PROBES, MOST_PROBES = 400, 12_800
#: Sample on which the closeness of neighbours is estimated: queries and vectors, the first by a hash of their ids.
SAMPLE_QUERIES, SAMPLE = 64, 20_000
#: Chances that are tried in turn until the sample's neighbours are found as often as asked.
CHANCES = (0.75, 0.85, 0.92, 0.96, 0.98, 0.99, 0.999)
#: Slack within which scores of a matrix product are scored again, one by one.
SLACK = 1e-9


@dataclass(frozen=True)
class Index:
    """tables x (directions and shifts); norm: the greatest; closeness: cosine of a k-th neighbour that three quarters exceed, augmented; success: chance to visit."""

    directions: np.ndarray  # tables, dimension + 1, projections
    shifts: np.ndarray  # tables, projections
    width: float
    norm: float
    closeness: float
    success: float = 1.0


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def vectors_of(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id and vector (double) of the rows that take part."""
    return rows.filter(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1) if len(whole) else np.zeros((0, 0))


def augmented(x: np.ndarray, norm: float) -> np.ndarray:
    scaled = x / norm
    return np.concatenate([scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1)))[:, None]], 1)


def turned(q: np.ndarray) -> np.ndarray:
    """Queries as unit vectors with nothing in the added component."""
    return np.concatenate([q / np.sqrt((q**2).sum(1))[:, None], np.zeros((len(q), 1))], 1)


def normal(x: np.ndarray) -> np.ndarray:
    """The standard normal distribution function, to 1e-7 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x > 0, 1 - tail, tail)


def fit(vectors: DataFrame, queries: DataFrame, k: int, tables: int, projections: int, width: float, recall: float, seed: int = 1) -> Index | None:
    """Directions from the seed; the greatest norm over all rows; closeness and the chance to visit from the bounded sample, None without rows."""
    norm2 = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    told = vectors.agg(F.max(norm2).alias("m"), F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    if not told["n"]:
        return None
    norm = math.sqrt(told["m"])
    some = lambda rows, n: rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).select("vec_id", "vector").collect()
    base, asked = some(vectors, SAMPLE), some(queries, SAMPLE_QUERIES)
    rng = np.random.default_rng(seed)
    index = Index(rng.standard_normal((tables, told["d"] + 1, projections)), rng.random((tables, projections)) * width, width, norm, 0.5)
    if not asked:
        return index
    ids, unit = np.array([r[0] for r in base]), augmented(np.array([r[1] for r in base]), norm)
    q = turned(np.array([r[1] for r in asked]))
    close = q @ unit.T
    close[np.array([r[0] for r in asked])[:, None] == ids[None, :]] = -np.inf
    at = min(close.shape[1], max(1, round(k * len(base) / told["n"])))
    nearest = np.argsort(-close, axis=1, kind="stable")[:, :at]
    there = np.isfinite(np.take_along_axis(close, nearest, 1))
    if not there.any():
        return index
    last = np.where(there, np.take_along_axis(close, nearest, 1), np.inf).min(1)
    index = replace(index, closeness=float(np.clip(np.quantile(last[np.isfinite(last)], 0.25), 0.0, 0.99)))
    for chance in CHANCES:
        found = np.zeros_like(there)
        for t in range(tables):
            who, cells = probes(index, q, t, chance)
            visited = set(zip(who.tolist(), names(cells), strict=True))
            where = names(buckets(index, unit, t))
            known = np.isin(np.arange(len(q)), who)
            found |= np.array([[not known[i] or (i, where[j]) in visited for j in row] for i, row in enumerate(nearest.tolist())])
        if (found & there).sum() >= recall * there.sum():
            return replace(index, success=chance)
    return index


def buckets(index: Index, unit: np.ndarray, table: int) -> np.ndarray:
    return np.floor((unit @ index.directions[table] + index.shifts[table]) / index.width).astype(np.int16)


def names(cells: np.ndarray) -> list[bytes]:
    """A bucket's cells as a key."""
    return [row.tobytes() for row in np.ascontiguousarray(cells)]


def probes(index: Index, unit: np.ndarray, table: int, success: float) -> tuple[np.ndarray, np.ndarray]:
    """Buckets in falling order of their chance until the chances reach ``success``: query numbers and cells.

    The best T tuples extend the best T shorter ones, so keeping T at each projection loses none of them; T doubles for queries whose T buckets don't
    reach ``success``. Those that would need more than MOST_PROBES have none.
    """
    rows, most = np.arange(len(unit)), PROBES
    who, cells = [], []
    while len(rows) and most <= MOST_PROBES:
        for first in range(0, len(rows), max(1, 200_000 // most)):
            own = rows[first : first + max(1, 200_000 // most)]
            chance, found = drawn(index, unit[own], table, most)
            visited = np.cumsum(chance, 1) - chance < success
            enough = chance.sum(1) >= success
            visited &= enough[:, None]
            who.append(own[np.nonzero(visited)[0]])
            cells.append(found[visited])
            rows[first : first + len(own)][enough] = -1
        rows, most = rows[rows >= 0], most * 2
    return (np.concatenate(who), np.concatenate(cells)) if who else (np.zeros(0, np.int64), np.zeros((0, index.directions.shape[2]), np.int16))


def drawn(index: Index, unit: np.ndarray, table: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Chances, falling, and cells of the ``most`` likeliest buckets of each query."""
    spread = math.sqrt(1 - index.closeness**2)
    centre = index.closeness * (unit @ index.directions[table]) + index.shifts[table]
    reach = int(math.ceil(5 * spread / index.width))
    n, m = centre.shape
    chance, cells = np.ones((n, 1)), np.zeros((n, 1, 0), np.int16)
    for j in range(m):
        near = np.floor(centre[:, j] / index.width)[:, None] + np.arange(-reach, reach + 1)
        lo = (near * index.width - centre[:, j][:, None]) / spread
        p = normal(lo + index.width / spread) - normal(lo)
        grown = (chance[:, :, None] * p[:, None, :]).reshape(n, -1)
        keep = min(most, grown.shape[1])
        best = np.argpartition(-grown, keep - 1, axis=1)[:, :keep]
        chance = np.take_along_axis(grown, best, 1)
        before, own = np.divmod(best, p.shape[1])
        cells = np.concatenate([np.take_along_axis(cells, before[:, :, None], 1), np.take_along_axis(near, own, 1)[:, :, None].astype(np.int16)], 2)
    order = np.argsort(-chance, axis=1, kind="stable")
    return np.take_along_axis(chance, order, 1), np.take_along_axis(cells, order[:, :, None], 1)


def hashed(rows: DataFrame, index: Index, success: float | None) -> DataFrame:
    """table, bucket and vector of each row in each table; with ``success``, of each bucket that a query visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                x = matrix(part.column("vector"))
                for t in range(len(index.directions)):
                    if success is None:
                        who, cells = np.arange(len(x)), buckets(index, augmented(x, index.norm), t)
                    else:
                        who, cells = probes(index, turned(x), t, success)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(who), t, np.int32)), pa.array(names(cells), pa.binary()), part.column("vec_id").take(pa.array(who)), part.column("vector").take(pa.array(who))],
                        ["table", "bucket", "vec_id", "vector"],
                    )

    return rows.mapInArrow(run, "table int, bucket binary, vec_id long, vector array<double>")


def best_of(queries: pa.Table, base: pa.Table, k: int) -> pa.Table:
    """The ``k`` best of a block for each query in it."""
    none = pa.table({"query_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "scores": pa.array([], pa.list_(pa.float64()))})
    if not queries.num_rows or not base.num_rows:
        return none
    q, b = matrix(queries.column("vector")), matrix(base.column("vector"))
    q_ids, b_ids = queries.column("vec_id").to_numpy(), base.column("vec_id").to_numpy()
    out = []
    for first in range(0, len(q), 1024):
        mine = q_ids[first : first + 1024]
        score = q[first : first + 1024] @ b.T
        score[mine[:, None] == b_ids[None, :]] = -np.inf
        if score.shape[1] > k:
            least = -np.partition(-score, k - 1, axis=1)[:, k - 1]
            rows, cols = np.nonzero((score >= least[:, None] - SLACK * np.maximum(1, np.abs(least))[:, None]) & np.isfinite(score))
        else:
            rows, cols = np.nonzero(np.isfinite(score))
        exact = np.einsum("ij,ij->i", q[first + rows], b[cols])  # the same sum for equal vectors, wherever they lie
        order = np.lexsort((b_ids[cols], -exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
        rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(rows)]])))
        top = rank < k
        rows, cols, exact = rows[top], cols[top], exact[top]
        found, sizes = np.unique(rows, return_counts=True)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        out.append(pa.table({"query_id": mine[found], "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(b_ids[cols])), "scores": pa.ListArray.from_arrays(pa.array(ends), pa.array(exact))}))
    return pa.concat_tables(out)


def blocked(rows: DataFrame, sizes: DataFrame, own: str, other: str) -> DataFrame:
    """Deals rows of a bucket into its ``own`` blocks and repeats them for each of the ``other`` side's."""
    joined = rows.join(sizes, ["table", "bucket"])
    return joined.select(
        "table", "bucket", F.pmod(F.xxhash64("vec_id"), F.col(own)).alias(own),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)).alias(other), "vec_id", "vector",
    )


def dealt(base: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id and score of the best of each block; both sides are (table, bucket, vec_id, vector)."""
    count = lambda rows, name: rows.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias(name))
    both = count(base, "nb").join(count(asked, "nq"), ["table", "bucket"])
    block = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("int")
    sizes = cut(both.select("table", "bucket", block("nb").alias("b_block"), block("nq").alias("q_block")))
    keys = ["table", "bucket", "b_block", "q_block"]
    left = blocked(asked, sizes, "q_block", "b_block").groupBy(*keys)
    right = blocked(base, sizes, "b_block", "q_block").groupBy(*keys)
    found = left.cogroup(right).applyInArrow(lambda q, b: best_of(q, b, k), "query_id long, ids array<long>, scores array<double>")
    return found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))


def owed(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id and how many candidates a query must get: ``k``, or all there are but its own."""
    few = [r[0] for r in vectors.select("vec_id").distinct().limit(k + 1).collect()]
    asked = queries.select(F.col("vec_id").alias("query_id")).distinct()
    own = F.col("query_id").isin(few).cast("int") if few else F.lit(0)
    return asked.withColumn("owed", F.lit(k) if len(few) > k else F.lit(len(few)) - own)


def search_alike(vectors: DataFrame, queries: DataFrame, k: int, tables: int, projections: int, width: float, recall: float, seed: int) -> DataFrame:
    """query_id, vec_id and score of what ``queries`` find among ``vectors`` of the same length, more than ``k`` perhaps."""
    index = fit(vectors, queries, k, tables, projections, width, recall, seed)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    near = cut(dealt(cut(hashed(vectors, index, None)), cut(hashed(queries, index, index.success)), k).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    got = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("got"))
    short = cut(owed(vectors, queries, k).join(got, "query_id", "left").filter(F.coalesce("got", F.lit(0)) < F.col("owed")).select(F.col("query_id").alias("vec_id")))
    if short.isEmpty():
        return near
    whole = lambda rows: rows.select(F.lit(-1).alias("table"), F.lit(b"").alias("bucket"), "vec_id", "vector")
    return near.join(short.withColumnRenamed("vec_id", "query_id"), "query_id", "left_anti").unionByName(dealt(whole(vectors), cut(whole(queries.join(short, "vec_id", "left_semi"))), k))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = 2, projections: int = 6, width: float = 2.0, recall: float = 0.95, seed: int = 1) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` nearest found among ``vectors``, without itself; all others, if there are fewer.

    Both are (vec_id, vector) as of ``vectors_of``. ``recall`` is the share of the sample's neighbours that the visited buckets must hold; with 1 or more
    every query is held against all vectors.
    """
    lengths = [r[0] for r in queries.select(F.size("vector")).distinct().collect()]
    found = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    for d in sorted(lengths):
        alike = lambda rows, d=d: rows.filter(F.size("vector") == d)
        found = found.unionByName(search_alike(alike(vectors), alike(queries), k, tables, projections, width, recall, seed))
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
