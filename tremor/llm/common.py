"""Shared pieces of the corpus operators: table access, materialised tables, Arrow row mapping, vectorised hashing."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Characters of text that one step inside a task holds at a time.
CHUNK_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, read by Spark (the path may be in any store Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where unset (tests, one machine) a folder set here; on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(os.path.abspath("spark-warehouse"), "shared")
        spark.sparkContext.setCheckpointDir(found)
        return found
    return found


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Shelf:
    """Named tables in the shared folder for steps that go in rounds: a new table of a name replaces the old one, which is deleted once the new one is written.

    A table's rows come from its files alone, so nothing that still runs reads a deleted one, and lost executors lose nothing.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[str, str] = {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """df written under name and read back."""
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes the tables of these names, as far as they are there."""
        for name in names:
            if path := self.paths.pop(name, None):
                place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def drop_but(self, *names: str) -> None:
        """Deletes all tables but those of these names."""
        self.drop(*(set(self.paths) - set(names)))


#: Share of all rows from which on a key is hot.
HOT = 0.001


def keyed_join(rows: DataFrame, facts: DataFrame, key: list[str], size: str, total: int) -> DataFrame:
    """rows with the facts of their key. Keys of over HOT of total rows (by facts' column size) go by broadcast, so they load no single task.

    There are at most 1 / HOT such keys, and their facts are a few numbers each.
    """
    found = facts.filter(F.col(size) > max(1000, total * HOT)).collect()
    if not found:
        return rows.join(facts, key)
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, facts.schema))
    return rows.join(hot, key).unionByName(rows.join(hot.select(*key), key, "left_anti").join(facts, key))


def held_out(id_col: str, mod: int, rest: int):
    """crc32 of the id as text, modulo mod, equals rest (false for a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest, F.lit(False))


def chunks(batch: pa.RecordBatch, text_index: int = 1) -> Iterator[tuple[list, ...]]:
    """A batch as tuples of Python lists, of about CHUNK_CHARS of text each; one very long text is a chunk of its own."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.binary_length(batch.column(text_index)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // CHUNK_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi > lo:
            piece = batch.slice(lo, hi - lo)
            yield tuple(piece.column(i).to_pylist() for i in range(piece.num_columns))


def map_texts(df: DataFrame, fn: Callable[..., dict], schema: StructType, setup: Callable[[], object] | None = None) -> DataFrame:
    """Apply fn to lists of rows inside tasks, without a shuffle.

    df's second column is the text. fn gets one list per column of df (and setup's value first, if setup is given) and
    returns a dict of equally long lists or arrays named as in schema.
    """
    arrow = to_arrow_schema(schema)

    def run(batches):
        state = (setup(),) if setup else ()
        for batch in batches:
            for lists in chunks(batch):
                out = fn(*state, *lists)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


# --- hashing words and shingles in numpy ------------------------------------------------------------------------------

_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (uint64 in, uint64 out)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of the hash base and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up, self.down = self._make(1 << 16)

    @staticmethod
    def _make(n: int) -> tuple[np.ndarray, np.ndarray]:
        def run(base: int) -> np.ndarray:
            out = np.ones(n, dtype=np.uint64)
            done, step = 1, base
            while done < n:  # doubling
                take = min(done, n - done)
                out[done : done + take] = out[:take] * np.uint64(step)
                step = step * step % 2**64
                done += take
            return out

        return run(_BASE), run(_INV)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = self._make(1 << (n - 1).bit_length())
        return self.up, self.down


POWERS = Powers()


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many spans of one byte array, by prefix sums."""
    up, down = POWERS.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * down[starts]
    return mix64(raw ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def spans_of(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    return edge[0::2], edge[1::2]


def append_columns(df: DataFrame, text_col: str, fn: Callable[[list], dict], fields: list) -> DataFrame:
    """df with further columns that fn makes from lists of texts, inside tasks and without a shuffle.

    The new names must not clash with df's; callers use names that start with two underscores.
    """
    schema = StructType([*df.schema.fields, *fields])
    arrow = to_arrow_schema(schema)
    at, new = df.columns.index(text_col), [arrow.field(f.name) for f in fields]

    def run(batches):
        for batch in batches:
            texts = batch.select([at])
            done = 0
            for (lists,) in chunks(texts, 0):
                out = fn(lists)
                piece = batch.slice(done, len(lists))
                done += len(lists)
                columns = [*piece.columns, *(pa.array(out[f.name], type=f.type) for f in new)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)
