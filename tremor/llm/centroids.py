"""Centroid clustering with adaptive bounds for each vector (Drake's bounds), over exact integers.

Every vector keeps an upper bound of its distance to its own centroid, the numbers of its next nearest centroids with a lower bound for each, in
ascending order, and one lower bound for all remaining ones. When centroids move, the upper bound grows by its centroid's step, each lower bound
shrinks by its centroid's, the remainder by the largest step of all. Where the upper bound stays under all lower ones nothing is computed. Else the
own distance is computed exactly, and then those of the listed centroids up to the first bound that certifies the rest; where even the remainder
bound doesn't, all centroids are rescanned. The number of bounds shrinks from a quarter of the centroids towards an eighth as far as the last round
needed none beyond.

Vectors are integers floor(scale * x), so distances, sums and means are exact and no order of tasks can change a result: bounds are in double
precision with a margin for rounding, and whatever they don't prove is decided by exact squared distances, ties going to the smaller number.

A round is one pass without a shuffle: it reads the last round's table, writes the next one with the vectors' new bounds, and beside them one row of
sums for each task and centroid. These few rows make the new centroids. Tables lie in the shared folder, and one is deleted when the next is written.

Defined cases: vectors that are null, of another length, or hold a null or non-finite component take no part; components beyond +-2**18 count as that,
so that squared distances fit a long; with fewer vectors than centroids each vector starts one; an empty table gives an empty result; equal ids are
vectors of their own, of which the smaller components start first; a null id comes last in the order of starts; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tremor.llm.common import Shelf

LIMIT = 2**26
#: Rows a step inside a task holds at a time.
ROWS = 4096
_SLACK = 1e-9


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= 2**20:  # then every partial sum is a whole number under 2**53
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


class Bounds:
    """Cluster, upper bound, listed centroids with their lower bounds, and remainder bound of some vectors."""

    def __init__(self, own: np.ndarray, upper: np.ndarray, near: np.ndarray, low: np.ndarray, rest: np.ndarray) -> None:
        self.own, self.upper, self.near, self.low, self.rest = own, upper, near, low, rest

    @staticmethod
    def scan(x: np.ndarray, centroids: np.ndarray, b: int) -> tuple[Bounds, np.ndarray]:
        """By all distances; also the squared distances to the own centroids."""
        d = squared(x, centroids)
        order = np.argsort(d, axis=1, kind="stable")  # equal distances: the smaller number first
        near = order[:, 1 : b + 1]
        root = np.sqrt(np.take_along_axis(d, order[:, : b + 2], 1).astype(np.float64))
        rest = root[:, b + 1] if d.shape[1] > b + 1 else np.full(len(x), np.inf)
        best = np.take_along_axis(d, order[:, :1], 1)[:, 0]
        return Bounds(order[:, 0], root[:, 0] * (1 + _SLACK), near, root[:, 1 : b + 1] * (1 - _SLACK), rest * (1 - _SLACK)), best

    def moved(self, steps: np.ndarray) -> None:
        """After the centroids have moved by steps."""
        self.upper = (self.upper + steps[self.own]) * (1 + _SLACK)
        self.low = (self.low - steps[self.near]) * (1 - _SLACK) - _SLACK
        self.rest = (self.rest - steps.max(initial=0.0)) * (1 - _SLACK) - _SLACK

    def cut(self, b: int) -> None:
        """Keep b listed centroids; the remainder bound covers the others."""
        if self.low.shape[1] > b:
            self.rest = np.minimum(self.rest, self.low[:, b:].min(1))
            self.near, self.low = self.near[:, :b], self.low[:, :b]

    def put(self, at: np.ndarray, other: Bounds) -> None:
        self.own[at], self.upper[at], self.near[at], self.low[at], self.rest[at] = other.own, other.upper, other.near, other.low, other.rest

    def settle(self, x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact own centroids again. Returns how many listed centroids each row had to look at (one more than listed: a full scan), and the rows' number of distances."""
        b = self.low.shape[1]
        looked, computed = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        # the least bound from each listed place on: places after the first one above the upper bound are certified together
        after = np.minimum.accumulate(np.concatenate([self.low, self.rest[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]
        at = np.flatnonzero(self.upper >= after[:, 0])
        if not len(at):
            return looked, computed
        exact = ((x[at] - centroids[self.own[at]]) ** 2).sum(1)
        self.upper[at] = np.sqrt(exact.astype(np.float64)) * (1 + _SLACK)
        computed[at] += 1
        need = (self.upper[at, None] >= after[at]).sum(1)  # after ascends, so these come first
        looked[at] = need
        for z in np.unique(need[(need > 0) & (need <= b)]).tolist():
            rows = at[need == z]
            listed = np.concatenate([self.own[rows, None], self.near[rows, :z]], axis=1)
            d = ((x[rows, None, :] - centroids[listed]) ** 2).sum(2)
            order = np.lexsort((listed, d), axis=1)
            listed, d = np.take_along_axis(listed, order, 1), np.take_along_axis(d, order, 1)
            root = np.sqrt(d.astype(np.float64))
            self.own[rows], self.upper[rows] = listed[:, 0], root[:, 0] * (1 + _SLACK)
            self.near[rows, :z], self.low[rows, :z] = listed[:, 1:], root[:, 1:] * (1 - _SLACK)
            computed[rows] += z
        rows = at[need > b]
        if len(rows):
            self.put(rows, Bounds.scan(x[rows], centroids, b)[0])
            computed[rows] += len(centroids)
        return looked, computed


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, size: int, scale: float) -> DataFrame:
    """(__id, __x): ids and vectors of exactly size finite components, as integers."""
    x = F.col(vector_col).cast("array<double>")
    good = (F.size(x) == size) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), v * F.lit(float(scale))))).cast("int"))
    return vectors.filter(F.coalesce(good, F.lit(False))).select(F.col(id_col).alias("__id"), whole.alias("__x"))


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors whose ids have the smallest SHA-256 behind the seed, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("__id").cast("string")), 256)
    found = rows.select(digest.alias("__hash"), "__x").orderBy(F.col("__hash").asc_nulls_last(), "__x").limit(k).collect()
    return np.array([r["__x"] for r in found], dtype=np.int64)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, ROWS) for batch in batches for i in range(0, batch.num_rows, ROWS))


def _round(rows: DataFrame, centroids: np.ndarray, steps: np.ndarray | None, b: int, last: bool) -> DataFrame:
    """rows with their bounds for these centroids (rows without bounds are scanned), and rows with __x null and __sums: a task's sums for one centroid.

    steps: how far each centroid moved since the bounds were made. last: with the squared distance to the own centroid.
    """
    ids = rows.schema["__id"]
    schema = T.StructType([
        ids, T.StructField("__x", T.ArrayType(T.IntegerType())), T.StructField("__own", T.IntegerType()), T.StructField("__upper", T.DoubleType()),
        T.StructField("__near", T.ArrayType(T.IntegerType())), T.StructField("__low", T.ArrayType(T.DoubleType())), T.StructField("__rest", T.DoubleType()), T.StructField("__distance", T.LongType()),
        T.StructField("__sums", T.ArrayType(T.LongType())), T.StructField("__n", T.LongType()), T.StructField("__looked", T.LongType()), T.StructField("__computed", T.LongType()),
    ])
    arrow = to_arrow_schema(schema)

    def batch_of(n: int, columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def lists(m: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))

    def run(batches):
        k, dims = centroids.shape
        sums, counts, looked, computed = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64), 0, 0
        for batch in _blocks(batches):
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            x = _matrix(column("__x"), np.int64)
            if steps is None:
                held, _ = Bounds.scan(x, centroids, b)
                computed += x.shape[0] * k
            else:
                number = lambda name, kind: column(name).to_numpy(zero_copy_only=False).astype(kind)  # noqa: B023, E731
                held = Bounds(number("__own", np.int64), number("__upper", np.float64), _matrix(column("__near"), np.int64), _matrix(column("__low"), np.float64), number("__rest", np.float64))
                held.moved(steps)
                held.cut(b)
                need, made = held.settle(x, centroids)
                looked, computed = max(looked, int(need[need <= b].max(initial=0))), computed + int(made.sum())
            order = np.argsort(held.own, kind="stable")
            own, first = np.unique(held.own[order], return_index=True)
            sums[own] += np.add.reduceat(x[order], first, axis=0)
            counts += np.bincount(held.own, minlength=k)
            yield batch_of(len(x), {
                "__id": column("__id"), "__x": column("__x"), "__own": pa.array(held.own), "__upper": pa.array(held.upper), "__near": lists(held.near),
                "__low": lists(held.low), "__rest": pa.array(held.rest),
                **({"__distance": pa.array(((x - centroids[held.own]) ** 2).sum(1))} if last else {}),
            })
        at = np.flatnonzero(counts)
        if len(at):
            same = lambda v: pa.array(np.full(len(at), v))
            yield batch_of(len(at), {"__own": pa.array(at), "__sums": lists(sums[at]), "__n": pa.array(counts[at]), "__looked": same(looked), "__computed": same(computed)})

    return rows.mapInArrow(run, schema)


def _means(table: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """New centroids from the tasks' sums, componentwise floor of the mean (an empty one stays); and how many listed centroids were looked at."""
    sums = table.filter("__sums IS NOT NULL")
    dims = centroids.shape[1]
    total = sums.groupBy("__own").agg(F.sum("__n").alias("n"), F.max("__looked").alias("z"), *(F.sum(F.col("__sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims))).collect()
    out = centroids.copy()
    for r in total:  # at most one row a centroid
        out[r["__own"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]
    return out, max((r["z"] for r in total), default=0)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: float = 256.0, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(__id, __own, __distance) of the vectors that take part, and the centroids."""
    shelf = Shelf(vectors.sparkSession)
    table = shelf.put("vectors", integer_vectors(vectors, id_col, vector_col, size, scale))
    centroids = first_centroids(table, k, seed)
    if not len(centroids):
        return table.select("__id", F.lit(0).alias("__own"), F.lit(0).cast("long").alias("__distance")), centroids
    most, least = max(1, len(centroids) // 4), max(1, len(centroids) // 8)
    b, steps = min(most, len(centroids) - 1), None
    for turn in range(rounds + 1):
        table = shelf.put("vectors", _round(table, centroids, steps, b, turn == rounds))
        if turn == rounds:
            break
        new, looked = _means(table, centroids)
        rows, steps = table.filter("__x IS NOT NULL"), np.sqrt(((new - centroids) ** 2).sum(1).astype(np.float64)) * (1 + _SLACK)
        if turn:  # the first round scans everything and says nothing of the bounds
            b = min(b, max(least, looked))
        table, centroids = rows, new
    return table.filter("__x IS NOT NULL").select("__id", "__own", "__distance"), centroids


def cluster_report(vectors: DataFrame, k: int = 40, rounds: int = 5) -> DataFrame:
    """Each vector's cluster, squared distance, inertia of its cluster and of all, and its centroid's digest."""
    found, centroids = cluster(vectors, k, rounds)
    per = {r["__own"]: r["s"] for r in found.groupBy("__own").agg(F.sum("__distance").alias("s")).collect()}  # at most k rows
    facts = [(i, per.get(i, 0), sum(per.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    named = found.sparkSession.createDataFrame(facts, "__own int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "__own").select(F.col("__id").alias("vec_id"), F.col("__own").alias("cluster"), F.col("__distance").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int, rounds: int) -> str:
    """The plain algorithm: all distances in every round."""
    nearest = """
a{r} AS MATERIALIZED (
  SELECT i, arg_min(c, d * 1000 + c) AS c, min(d) AS d FROM (
    SELECT v.i, m.c, sum((v.x - m.x) * (v.x - m.x))::BIGINT AS d FROM v JOIN m{r} m USING (j) GROUP BY v.i, m.c) GROUP BY i
)"""
    means = """
m{s} AS MATERIALIZED (
  SELECT m.c, m.j, coalesce(n.x, m.x) AS x FROM m{r} m LEFT JOIN (
    SELECT a.c, v.j, ((sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM a{r} a JOIN v USING (i) GROUP BY a.c, v.j) n USING (c, j)
)"""
    steps = [nearest.format(r=r) + ("," + means.format(r=r, s=r + 1) if r < rounds else "") for r in range(rounds + 1)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id), embedding) - 1 AS i, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
), v AS MATERIALIZED (SELECT i, unnest(range(64)) AS j, unnest(x) AS x FROM kept), m0 AS MATERIALIZED (SELECT i AS c, j, x FROM v WHERE i < {k}),
{",".join(steps)},
digest AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS h FROM m{rounds} GROUP BY c)
SELECT vec_id, a.c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, h AS centroid_sha256
FROM a{rounds} a JOIN kept USING (i) JOIN digest ON digest.c = a.c
"""


SQL = _sql(40, 5)
