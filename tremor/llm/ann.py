"""Approximate nearest neighbours: inverted lists scanned by adaptive dimension sampling.

Vectors are assigned to the nearest of nlist centroids, by default as many as the square root of the rows, so lists grow no faster than
that. The centroids come from k-means in two levels on a sample of `sample_rows` rows, or four rows a list where that is more. Lists are
split into blocks of at most `block_rows` vectors, and each query meets the blocks of its nearest lists: enough lists that they make `probe` of all
lists and hold more than k vectors. Inside a block the vectors are rotated by one fixed random orthogonal matrix and scanned
in blocks of columns: after each, a candidate is abandoned when its partial distance, scaled to all dimensions, exceeds the
current k-th distance by more than the hypothesis test at eps0 and rounding allow. Survivors are compared exactly, on the original
vectors in double precision, ties to the smaller id.

Centroids and list sizes are as many as the square root of the rows; vectors and queries are shuffled by (list, block), never gathered.

Defined cases: vectors that are null, zero, hold null or non-finite components, or are not of the most common length take no
part; with no more than k candidates all are returned; repeated vectors are candidates of their own; the query's own id
is left out; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = 16
#: Centroids up to which k-means has one level.
FLAT_LISTS = 512
#: Distances to centroids that a task holds at a time.
CELLS = 4_000_000
#: Rounding of the rotated vectors, as a share of the squared lengths of query and vector: distances that differ by less are ties.
SLACK = 1e-12


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """Rows (__id, __v) that take part, and their length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("__id"), F.col(vec_col).alias("__v")).filter(
        F.col("__id").isNotNull() & F.col("__v").isNotNull() & F.forall("__v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("__v", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("__v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    return rows.filter(F.size("__v") == d), d


def rotation(d: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Lloyd's algorithm on a bounded sample."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, c, 1)[:, 0]
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c


def two_level_kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """About k centroids: where they are many, first their square root, then each cluster's share of k inside it."""
    if k <= FLAT_LISTS:
        return kmeans(x, k)
    top = nearest(x, kmeans(x, round(math.sqrt(k))), 1)[:, 0]
    parts = [x[top == i] for i in np.unique(top)]
    return np.concatenate([kmeans(p, max(1, min(len(p), round(k * len(p) / len(x))))) for p in parts])


def nearest(x: np.ndarray, c: np.ndarray, m: int) -> np.ndarray:
    """Indices of the m nearest centroids of each row, nearest first."""
    step = max(1, CELLS // len(c))  # rows whose distances are held at a time
    if len(x) > step:
        return np.concatenate([nearest(x[i : i + step], c, m) for i in range(0, len(x), step)])
    gap = (c * c).sum(1) - 2.0 * (x @ c.T)
    if m == 1:
        return gap.argmin(1)[:, None]
    return np.argsort(gap, axis=1, kind="stable")[:, :m]


def probes_for(x: np.ndarray, c: np.ndarray, k: int, recall: float, asked: int = 300) -> int:
    """Lists to probe so that this share of the k nearest sample rows of some sample rows lies in them."""
    own = nearest(x, c, 1)[:, 0]
    place = []
    for i in range(0, len(x), max(1, len(x) // asked)):
        gap = ((x - x[i]) ** 2).sum(1)
        gap[i] = np.inf
        order = np.empty(len(c), dtype=np.int64)
        order[nearest(x[i : i + 1], c, len(c))[0]] = np.arange(len(c))
        place.append(order[own[np.argsort(gap)[: min(k, len(x) - 1)]]])
    found = np.concatenate(place)
    return int(np.quantile(found, recall, method="higher")) + 1 if len(found) else 1


def scan(q: np.ndarray, own: int, ids: np.ndarray, rows: np.ndarray, turned: list[np.ndarray], turned_q: np.ndarray, k: int, eps0: float) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows of a block: ids and distances. turned: the rotated rows in blocks of columns."""
    d = rows.shape[1]
    alive = np.flatnonzero(ids != own)
    partial = np.zeros(len(alive))
    slack = SLACK * ((q * q).sum() + (rows[alive] ** 2).sum(1))
    limit = np.inf
    done = 0
    for part in turned:
        gap = part[alive] - turned_q[done : done + part.shape[1]]
        partial += (gap * gap).sum(1)
        done += part.shape[1]
        if done < d and len(alive) > k:
            if limit == np.inf:  # the distances of the first k by their partial distances bound the k-th
                first = alive[np.argpartition(partial, k - 1)[:k]]
                limit = ((rows[first] - q) ** 2).sum(1).max()
            keep = (partial - slack) * (d / done) <= limit * (1.0 + eps0 / math.sqrt(done)) ** 2
            keep[np.argpartition(partial, k - 1)[:k]] = True  # never fewer than k
            alive, partial, slack = alive[keep], partial[keep], slack[keep]
    if len(alive) > k:
        alive = alive[partial - slack <= np.partition(partial + slack, k - 1)[k - 1] * (1 + 1e-9)]  # ties stay for the exact comparison
    exact = np.sqrt(((rows[alive] - q) ** 2).sum(1))
    order = np.lexsort((ids[alive], exact))[:k]
    return ids[alive][order], exact[order]


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = 0.96, nlist: int | None = None, sample_rows: int = 20_000, block_rows: int = 8192, eps0: float = 2.1
) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of each query's k nearest rows; queries has the columns of vectors."""
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows, d = usable(vectors, id_col, vec_col)
    asked, _ = usable(queries, id_col, vec_col)
    n = rows.count() if d else 0
    if not n:
        return spark.createDataFrame([], out)
    asked = asked.filter(F.size("__v") == d)
    lists = nlist or max(1, round(math.sqrt(n)))
    sample_rows = max(sample_rows, 4 * lists)
    share = min(1.0, sample_rows / n)
    part = rows.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) <= F.lit(int(share * (1 << 20)))).select("__v").limit(2 * sample_rows).toArrow()
    x = np.array(part["__v"].to_pylist(), dtype=np.float64).reshape(-1, d)
    centroids = two_level_kmeans(x, max(1, min(lists, len(x) // 4)))  # fewer only where the table itself is tiny
    lists = len(centroids)
    turn = rotation(d)

    def assign(batches):
        for pdf in batches:
            v = np.array(pdf["__v"].tolist(), dtype=np.float64).reshape(-1, d)
            yield pd.DataFrame({"__list": nearest(v, centroids, 1)[:, 0].astype(np.int32), "__id": pdf["__id"], "__v": pdf["__v"]})

    vec = rows.schema["__v"].dataType
    listed = rows.mapInPandas(assign, T.StructType([T.StructField("__list", T.IntegerType()), T.StructField("__id", T.LongType()), T.StructField("__v", vec)]))
    sizes = np.zeros(lists, dtype=np.int64)
    for r in listed.groupBy("__list").count().collect():  # a row per list
        sizes[r["__list"]] = r["count"]
    blocks = np.maximum(1, -(-sizes // block_rows))
    probes = probes_for(x, centroids, k, recall)

    def route(batches):
        for pdf in batches:
            v = np.array(pdf["__v"].tolist(), dtype=np.float64).reshape(-1, d)
            order = nearest(v, centroids, lists)
            some = np.maximum(probes, (np.cumsum(sizes[order], axis=1) <= k).sum(1) + 1)
            at = np.repeat(np.arange(len(pdf)), np.minimum(some, lists))
            chosen = np.concatenate([o[:m] for o, m in zip(order, some, strict=True)]) if len(pdf) else np.empty(0, dtype=np.int64)
            yield pd.DataFrame({"__list": chosen.astype(np.int32), "__id": pdf["__id"].to_numpy()[at], "__v": pdf["__v"].to_numpy()[at]})

    routed = asked.mapInPandas(route, listed.schema)
    asks = np.zeros(lists, dtype=np.int64)
    for r in routed.groupBy("__list").count().collect():  # a row per list
        asks[r["__list"]] = r["count"]
    turns = np.maximum(1, -(-asks // block_rows))
    table = spark.createDataFrame([(i, int(b), int(t)) for i, (b, t) in enumerate(zip(blocks, turns, strict=True))], "__list int, __blocks int, __turns int")
    spread = lambda df, own, other: (  # noqa: E731  a row's own slot by its id, and every slot of the other side
        df.join(F.broadcast(table), "__list")
        .withColumn(own, F.pmod(F.xxhash64("__id"), F.col(f"{own}s")).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
        .select("__list", "__block", "__turn", "__id", "__v")
    )
    key = ["__list", "__block", "__turn"]

    def block(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        got: list[tuple[np.ndarray, ...]] = []
        if len(left) and len(right):
            ids = left["__id"].to_numpy()
            v = np.array(left["__v"].tolist(), dtype=np.float64).reshape(-1, d)
            t = v @ turn
            turned = [np.ascontiguousarray(t[:, c : c + COLUMNS]) for c in range(0, d, COLUMNS)]
            asks = np.array(right["__v"].tolist(), dtype=np.float64).reshape(-1, d)
            for own, q, q_turned in zip(right["__id"].to_numpy(), asks, asks @ turn, strict=True):
                found, far = scan(q, own, ids, v, turned, q_turned, k, eps0)
                got.append((np.full(len(found), own), found, far))
        names = ("query_id", "vec_id", "score")
        return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*got, strict=True)), strict=True)) if got else {name: [] for name in names})

    near = spread(listed, "__block", "__turn").groupBy(*key).cogroup(spread(routed, "__turn", "__block").groupBy(*key)).applyInPandas(block, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def neighbour_report(vectors: DataFrame) -> DataFrame:
    """The ten nearest rows of every row whose vec_id is divisible by 100."""
    return nearest_neighbours(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
