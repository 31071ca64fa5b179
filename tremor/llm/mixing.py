"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a fixed pseudo-random order, form blocks of `block_docs`. With weights w_s that sum to 1, block k of source s may not
start before slot floor(k / w_s) (its release) and must be placed before slot ceil((k + 1) / w_s) (its deadline). Earliest deadline first
over released blocks then keeps every source within one block of its share at every slot, for any number of slots. Weights are whole
multiples of 2**-40 (a billion slots move the target by a thousandth of a block), and all arithmetic is exact.

The mix is scheduled in segments of SEGMENT slots, each in a task of its own. How many blocks of each source lie before a border follows from the
border alone: a block whose window ends there or before does, one that starts there or later doesn't, and of those whose windows hold the border as
many do as slots are left. These are chosen so that both sides can be scheduled: in the order of their deadlines, whenever the slots up to
a deadline behind the border could not take all of the blocks that must end by then, the earliest released of them goes before it; then the earliest
released of all fill up. Both conditions are Hall's, on chains of intervals, so the choice succeeds whenever one exists, and earliest
deadline first over the whole mix is one.

No source is ranked in one task: documents are dealt to buckets of the hash of their id, buckets are counted, and a document's number is its place in
the bucket plus the counts of earlier buckets.

A source that ends early leaves its slots empty; the others keep theirs, so every document is kept exactly once and the weights
hold up to the slot where the first source ends.

Defined cases: null sources are a source of their own, with its own weight (key NO_SOURCE); rows that share an id are ordered by the hash of
their text, and so are rows without an id; documents of a source without a weight raise a ValueError that names it, and none is dropped; weights
that are not positive, or under 2**-30 of all, raise; a mix of more than MOST_EMPTY times as many slots as blocks raises (its weights don't
fit its sources); weights of sources without documents leave their slots empty; an empty table gives an empty result; further columns stay.
"""

from __future__ import annotations

from fractions import Fraction
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Weights are whole multiples of one over this.
UNIT = 1 << 40
#: Slots that one task schedules.
SEGMENT = 1 << 15
#: Slots for each block that the longest mix has.
MOST_EMPTY = 4096
#: Rows up to which the schedule is broadcast.
BROADCAST_ROWS = 50_000
NO_SOURCE = "\x00none"


def integer_weights(weights: dict[str, float]) -> dict[str, int]:
    """Each source's weight in about UNIT-ths; their sum is the whole."""
    if not weights:
        return {}
    if min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    total = sum(Fraction(w) for w in weights.values())
    got = {s: round(Fraction(w) / total * UNIT) for s, w in weights.items()}
    least = min(got, key=lambda s: (got[s], s))
    if got[least] < 1024:
        raise ValueError(f"the weight of {least!r} is too small beside the others")
    return got


def blocks_before(t: int, shares: list[int]) -> list[int]:
    """How many blocks of each source lie before slot t; shares sum to the whole."""
    whole = sum(shares)
    before = [t * m // whole for m in shares]
    left = t - sum(before)
    if not left:
        return before
    after = [-(-t * m // whole) for m in shares]
    open_ = sorted((-(-(k + 1) * whole // m), k * whole // m, i) for i, (k, m, a) in enumerate(zip(before, shares, after, strict=True)) if a > k)
    ready: list[tuple[int, int]] = []
    chosen = 0
    for place, (deadline, release, i) in enumerate(open_, 1):
        heappush(ready, (release, i))
        if place < len(open_) and open_[place][0] == deadline:
            continue
        room = deadline - t - sum(max(0, deadline * m // whole - a) for m, a in zip(shares, after, strict=True))
        while place - chosen > room:
            before[heappop(ready)[1]] += 1
            chosen += 1
    while chosen < left:
        before[heappop(ready)[1]] += 1
        chosen += 1
    return before


def pfair_segment(first: int, last: int, shares: list[int]) -> list[tuple[int, int]]:
    """(source's number, its block) of each slot from first to last, earliest deadline first among the released."""
    whole = sum(shares)
    start, stop = blocks_before(first, shares), blocks_before(last, shares)
    release = lambda i, k: max(first, k * whole // shares[i])
    waiting = [(release(i, k), i, k) for i, k in enumerate(start) if k < stop[i]]
    heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    for t in range(first, last):
        while waiting and waiting[0][0] <= t:
            _, i, k = heappop(waiting)
            heappush(ready, (min(last, -(-(k + 1) * whole // shares[i])), i, k))
        deadline, i, k = heappop(ready)
        if deadline <= t:
            raise ValueError(f"slot {t} is too late for block {k}")
        out.append((i, k))
        if k + 1 < stop[i]:
            heappush(waiting, (release(i, k + 1), i, k + 1))
    return out


def tempered_weights(docs: DataFrame, source_col: str = "source", power: float = 0.5) -> dict[str, float]:
    """A weight for each source: its number of documents to a power (a row per source is gathered)."""
    counts = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)).alias("s")).count().collect()
    return {r["s"]: float(r["count"]) ** power for r in counts}


def scheduled(spark: SparkSession, shares: list[int], blocks: list[int], names: list[str], segment: int = SEGMENT) -> DataFrame:
    """(__source, __block, __slot) of the blocks there are, a segment of slots in each task."""
    whole = sum(shares)
    slots = max(-(-n * whole // m) for n, m in zip(blocks, shares, strict=True))
    if slots > MOST_EMPTY * sum(blocks) + segment:
        raise ValueError("a source's weight is too small for its size: the mix would be nearly empty")
    segments = -(-slots // segment)

    def run(frames):
        for pdf in frames:
            for k in pdf["id"]:
                made = [(names[i], b, int(k) * segment + j) for j, (i, b) in enumerate(pfair_segment(int(k) * segment, min(slots, (int(k) + 1) * segment), shares)) if b < blocks[i]]
                yield pd.DataFrame(made, columns=["__source", "__block", "__slot"])

    return spark.range(0, segments, 1, min(segments, 4096)).mapInPandas(run, "__source string, __block long, __slot long")


def mix_sources(docs: DataFrame, weights: dict[str, float], block_docs: int = 8, id_col: str = "doc_id", source_col: str = "source", text_col: str | None = "text", bucket_docs: int = 2000) -> DataFrame:
    """docs with __block (in its source), __slot (in the mix) and __place (in the block)."""
    spark = docs.sparkSession
    new = T.StructType([*docs.schema.fields, T.StructField("__block", T.LongType()), T.StructField("__slot", T.LongType()), T.StructField("__place", T.LongType())])
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE))
    shares = integer_weights(weights)
    names = sorted(shares)
    share = spark.createDataFrame([(s,) for s in names], "__source string").withColumn("__known", F.lit(True))
    sizes = docs.groupBy(source.alias("__source")).count().join(share, "__source", "left").collect()  # a row for each source
    if missing := sorted(r["__source"] for r in sizes if not r["__known"]):
        raise ValueError(f"no weight for source {missing[0]!r}")
    if not sizes:
        return spark.createDataFrame([], new)
    n_docs = sum(r["count"] for r in sizes)
    blocks = {r["__source"]: -(-r["count"] // block_docs) for r in sizes}
    schedule = scheduled(spark, [shares[s] for s in names], [blocks.get(s, 0) for s in names], names)
    order = F.xxhash64(F.col(id_col).cast("string"))
    if text_col:
        order = F.when(F.col(id_col).isNotNull(), order).otherwise(F.xxhash64(F.lit(0), text_col))
    buckets = 1 << max(0, n_docs // bucket_docs).bit_length()
    keyed = docs.withColumns({"__source": source, "__h": order, "__bucket": F.shiftrightunsigned(order, 44).cast("long") * buckets / F.lit(1 << 20)}).withColumn("__bucket", F.floor("__bucket").cast("long"))
    counts = keyed.groupBy("__source", "__bucket").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy("__source").orderBy("__bucket")) - F.col("__n")).drop("__n")
    ties = [F.xxhash64(text_col)] if text_col else []
    place = F.row_number().over(Window.partitionBy("__source", "__bucket").orderBy("__h", F.col(id_col), *ties)) - 1
    ranked = keyed.withColumn("__at", place).join(before, ["__source", "__bucket"]).withColumn("__rank", F.col("__before") + F.col("__at"))
    placed = ranked.withColumn("__block", F.floor(F.col("__rank") / block_docs).cast("long")).withColumn("__place", F.col("__rank") % block_docs)
    placed = placed.join(F.broadcast(schedule) if sum(blocks.values()) <= BROADCAST_ROWS else schedule, ["__source", "__block"])
    return placed.select(*docs.columns, "__block", "__slot", F.col("__place").cast("long").alias("__place"))


def mix_report(docs: DataFrame, block_docs: int = 8) -> DataFrame:
    """Each document's source block and slot in the mix with weights of the square root of the sources' sizes."""
    rows = docs.select("doc_id", "source")
    mixed = mix_sources(rows, tempered_weights(rows), block_docs, text_col=None)
    return mixed.select("doc_id", "source", F.col("__block").alias("block"), F.col("__slot").alias("slot"), F.col("__place").alias("place"))
