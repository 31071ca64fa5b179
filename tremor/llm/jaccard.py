"""N-gram Jaccard join by token-combination prefixes.

A document is its set of distinct 4-word shingles (64-bit hashes). Documents with equal sets form a class at once; the join then finds all
pairs of classes whose Jaccard similarity reaches the threshold, as far as connectivity needs them, and returns each document's
component. No link is lost:

* A set of n shingles shares at least ceil(t * n) of them with any partner, so it may miss tau = n - ceil(t * n). Under one
  global order of shingles, a prefix whose classes of shingles promise more than tau must share, in some class, as many shingles with the
  partner's prefix as the class asks for.
* The order: first the shingles of a fixed part of the hash range by their document frequency (counted over all documents), then
  the other rare ones, last the frequent ones. Rare shingles are classes of their own and are indexed alone. Frequent ones (about FREQUENT of
  all sets hold them, so they number at most 2 / FREQUENT times the mean set size) fall into groups by hash, and only pairs of them in one
  group are indexed, in families of neighbouring set sizes; a group of x promises x - 1. Prefixes are extended until they promise tau + 1.
* Lists of an index entry are not expanded into pairs. Each list's likely original, its head (the class with the fewest shingles that nobody
  shares), meets the others of the list, and exact overlaps decide. Lists that lie in one component are closed.
* The sets that met one head, near or far, are its group; of a group of more than BLOCK sets, those of neighbouring sizes are groups of their
  own, as others don't link. A group of at most BLOCK sets (nearly all are) is decided at once inside one task:
  counts by parts of the hash range bound all overlaps, exact overlaps decide what the bounds leave, and sets that are known to be
  connected don't meet again; only the links that connect go out.
* What is left of a longer list is indexed again, by what each set differs in from the head. Let e be the size of such a difference. Two sets x and y
  link when the symmetric difference of theirs, e_x + e_y - 2 * shared, is at most D = (1 - t) / (1 + t) * (|x| + |y|). So their
  differences share at least (e_x + e_y - D) / 2 shingles; where that is 0 or less, both link with the head. A shingle in which
  one set of the head's alone differs is shared with nobody and uses up the prefix, so sets with changes of their own leave few
  entries or none. Entries are kept by bands of both sizes, which bound the overlap from below. New lists of at most SMALL sets
  meet pair by pair, but for pairs that the differences' counts in parts of the hash range refute; longer ones go through a head
  again, until none is left: every list loses its head in each round.
* A set far from the head is indexed in the same way by all its shingles, as if the head were empty; sets on the border go both ways, so
  that any two within a link's reach meet in one of them.

Exact overlaps come from the texts: pairs are grouped by their first side, split into salted groups, and compared in a sorted
pass that holds one text's set at a time. Lists with over HOT of all rows (at most 1 / HOT of them) meet their heads in a broadcast join.

Defined cases: null, empty and blank texts have no shingles and link with nothing; fewer than four words are one shingle; exact copies link;
rows that share an id are documents of their own; so are rows with a null id, whose component is the smallest id they link with, and null where
all ids linked are null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tremor.llm.common import HOT, Shelf, chunks, keyed_join, mix64, span_hashes, spans_of
from tremor.llm.components import components

WORDS = 4
#: Share of the hash range whose shingles are ordered by document frequency.
COUNTED = 0.22
#: Share of all sets from which on a shingle is frequent.
FREQUENT = 0.005
#: A head's partners in one group of comparisons.
SALT_ROWS = 64
#: Rows of a list that meet pair by pair, without a head.
SMALL = 64
#: Sets, and shingles of all of them, up to which a head's group, or its sets of neighbouring sizes, are decided at once inside a task.
BLOCK, BLOCK_SHINGLES = 4096, 4_000_000
#: Bytes of text that are hashed together.
TOGETHER = 1 << 16
#: Distance to a head up to which a set is indexed by its differences from it.
NEAR = 0.5
#: Parts of the hash range that bound an overlap, three counts of 16 bits to a long.
BUCKETS = 63
_TOP = 0x8000_8000_8000
_LOWEST = 0x7FFF

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)  # one for each place in a shingle


def shingles_of(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return shingle_sets([text], words)[0]


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """shingles_of each text; short texts are hashed together."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0
    for t in texts:
        held.append(t.encode("utf-8", "surrogatepass") if t else b"")
        size += len(held[-1])
        if size >= TOGETHER:
            out += _shingles(held, words)
            held, size = [], 0
    return out + _shingles(held, words) if held else out


def _shingles(texts: list[bytes], words: int) -> list[np.ndarray]:
    data = _LOWER[np.frombuffer(b" ".join(texts), dtype=np.uint8)]  # no word crosses the space
    first, last = spans_of(~_SPACE[data])
    h = span_hashes(data, first, last)

    def shingles(lo: int, hi: int, k: int) -> np.ndarray:  # of k words each, among the words lo to hi
        n = hi - lo - k + 1
        total = h[lo : lo + n] * _STEP[0]
        for i in range(1, k):
            total += h[lo + i : lo + i + n] * _STEP[i]
        return mix64(total + np.uint64(k))

    every = shingles(0, len(h), words) if len(h) >= words else h[:0]
    ends = np.searchsorted(first, np.cumsum([len(t) + 1 for t in texts])).tolist()
    out = []
    for lo, hi in zip([0, *ends], ends, strict=False):
        v = np.sort(every[lo : hi - words + 1] if hi - lo >= words else shingles(lo, hi, hi - lo)) if hi > lo else h[:0]
        if len(v) > 1:
            new = np.empty(len(v), dtype=bool)
            new[0] = True
            np.not_equal(v[1:], v[:-1], out=new[1:])
            v = v[new]
        out.append(v)
    return out


def set_key(h: np.ndarray) -> int:
    """A signed 64-bit key of a set."""
    if not len(h):
        return 0
    s = np.array([mix64(h ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64) ^ np.uint64(len(h))], dtype=np.uint64)
    return int(mix64(s).view(np.int64)[0])


def required(n: int, percent: int) -> int:
    """Least overlap of a set of n with a partner that reaches the threshold."""
    return -(-percent * n // 100)


def signatures(h: np.ndarray, frequent: np.ndarray, percent: int, cut: np.uint64) -> tuple[np.ndarray, int, np.ndarray]:
    """Shingles to count, how many of the prefix they have to make up, and index entries that need no counting."""
    n = len(h)
    need = n - required(n, percent) + 1
    rare = h
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        rare = h[frequent[at] != h]
    inner = int(np.searchsorted(rare, cut))
    counted = rare[:inner]
    if inner >= need:
        return counted, need, h[:0]
    direct = [rare[inner : inner + need - inner]]
    left = need - len(rare)
    if left > 0:  # few rare ones: frequent ones, by hash
        often = np.setdiff1d(h, rare, assume_unique=True)
        step = np.log(100 / percent) * (1 + 1e-9)  # partners' sizes never lie more than a family apart, rounding included
        for family in (int(np.log(n) / step), int(np.log(n) / step) + 1):
            tau = np.exp(family * step) * (100 - percent) / 100
            tag = mix64(np.array([family + 1], dtype=np.uint64))[0]
            if tau < 4:
                direct.append(mix64(often[:left] ^ tag))
                continue
            groups = max(1, round(tau / 4))
            group = (mix64(often) % np.uint64(groups)).astype(np.int64)
            seen: dict[int, list] = {}
            promised = 0
            for g, x in zip(group.tolist(), often, strict=True):
                held = seen.setdefault(g, [])
                promised += bool(held)
                held.append(x)
                if promised >= left:
                    break
            for held in seen.values():
                v = np.array(held, dtype=np.uint64)
                i, j = np.triu_indices(len(v), 1)
                direct.append(mix64(mix64(v[i]) * np.uint64(3) + v[j] ^ tag))
    return counted, need, np.concatenate(direct)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))


def set_table(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(__id, __n, __node): size and key of each document's set; and (__h, __c), shingles that many sets of a task hold, and in how many.

    A task counts its distinct sets chunk by chunk and leaves out what a chunk holds once, so a count is too small by at most one a chunk.
    """
    rows = _rows(docs, id_col, text_col)
    schema = T.StructType([
        T.StructField("__id", rows.schema["__id"].dataType), T.StructField("__n", T.LongType()), T.StructField("__node", T.LongType()),
        T.StructField("__h", T.LongType()), T.StructField("__c", T.LongType()),
    ])
    arrow = to_arrow_schema(schema)
    batch_of = lambda n, columns: pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def run(batches):
        seen = set()
        often = (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))
        for batch in batches:
            for ids, texts in chunks(batch):
                sets = shingle_sets(texts, words)
                keys = [set_key(h) for h in sets]
                yield batch_of(len(ids), {"__id": ids, "__n": [len(h) for h in sets], "__node": keys})
                new = {k: h for k, h in zip(keys, sets, strict=True) if len(h) and k not in seen}
                seen.update(new)
                if new:
                    h, c = np.unique(np.concatenate(list(new.values())), return_counts=True)
                    often = _merged(often, (h[c > 1], c[c > 1]), len(seen) * FREQUENT / 8)
        h, c = (x[often[1] >= len(seen) * FREQUENT / 2] for x in often)
        if len(h):
            yield batch_of(len(h), {"__h": h.view(np.int64), "__c": c})

    return rows.mapInArrow(run, schema)


def _merged(a: tuple, b: tuple, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums of two counts by key, without those under least."""
    h, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    c = np.bincount(at, weights=np.concatenate([a[1], b[1]]), minlength=len(h)).astype(np.int64)
    return h[c >= least], c[c >= least]


def frequent_shingles(sets: DataFrame, n_sets: int) -> np.ndarray:
    """Sorted shingles that at least FREQUENT / 2 of all sets hold (as counted by set_table); at most 2 / FREQUENT times the mean set size."""
    counted = sets.filter("__h IS NOT NULL").groupBy("__h").agg(F.sum("__c").alias("c")).filter(F.col("c") >= max(50, n_sets * FREQUENT / 2)).select("__h")
    return np.sort(np.array([r["__h"] for r in counted.collect()], dtype=np.int64).view(np.uint64))


def index_table(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(__sig, __node, __n, __own): index entries; __own: counted shingles that the class shares with nobody."""
    rows = _rows(docs, id_col, text_col)
    cut = np.uint64(int(COUNTED * 2.0**64))
    # few and narrow columns, as this is the largest shuffle: __sizes holds the set's size above its counted shingles, __salt is 0 for entries that are counted
    schema = T.StructType([T.StructField(c, kind, False) for c, kind in (("__sig", T.LongType()), ("__node", T.LongType()), ("__sizes", T.LongType()), ("__salt", T.IntegerType()))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        seen = set()  # classes of this partition: copies inside it count once
        for batch in batches:
            for _, texts in chunks(batch):
                parts: list[tuple] = []
                for h in shingle_sets(texts, words):
                    if not len(h) or (node := set_key(h)) in seen:
                        continue
                    seen.add(node)
                    counted, _, direct = signatures(h, frequent, percent, cut)
                    salts = np.zeros(len(counted) + len(direct), dtype=np.int32)
                    salts[len(counted) :] = 1 + node % 1024
                    parts.append((np.concatenate([counted, direct]).view(np.int64), node, len(h) << 32 | len(counted), salts))
                if not parts:
                    continue
                sizes = [len(p[0]) for p in parts]
                many = lambda k: np.repeat(np.array([p[k] for p in parts], dtype=np.int64), sizes)  # noqa: B023, E731
                columns = [np.concatenate([p[0] for p in parts]), many(1), many(2), np.concatenate([p[3] for p in parts])]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    found = rows.mapInArrow(run, schema)
    # entries of frequent shingles are dealt by class as well: their lists may be long, and they need no counting
    dealt = found.repartition("__sig", "__salt")
    counted = dealt.dropDuplicates(["__sig", "__salt", "__node"]).withColumn("__df", F.expr("count(*) OVER (PARTITION BY __sig, __salt)")).filter("__df > 1 OR __salt > 0")
    # of a class's counted shingles those in one set only come first in the order, and meet nobody
    rank = F.expr("row_number() OVER (PARTITION BY __node ORDER BY __salt > 0, __df, __sig)")
    ranked = counted.withColumn("__k", rank).withColumn("__shared", F.expr("count_if(__salt = 0) OVER (PARTITION BY __node)"))
    named = ranked.select("__sig", "__node", "__salt", "__k", F.expr("cast(shiftright(__sizes, 32) AS int)").alias("__n"), F.expr(f"(__sizes & {(1 << 32) - 1}L) - __shared").alias("__own"))
    need = f"__n - (cast(__n AS long) * {percent} + 99) DIV 100 + 1"
    return named.filter(f"__salt > 0 OR __k <= {need} - __own").select("__sig", "__node", "__n", "__own")


def with_heads(lists: DataFrame) -> DataFrame:
    """Rows of the lists (__sig, __node, __n, __own, __label, __group) that hold several labels, with their list's size __c and its head."""
    total = lists.count()
    over = Window.partitionBy("__sig")
    facts = {
        "__c": F.count("*"), "__s": F.min(F.struct("__own", F.col("__node").alias("__head"), F.col("__n").alias("__hn"))),
        "__lo": F.min("__label"), "__hi": F.max("__label"),
    }
    found = lists.groupBy("__sig").count().filter(F.col("count") > max(1000, total * HOT)).select("__sig").collect()  # at most 1 / HOT
    cold, parts = lists, []
    if found:
        keys = F.broadcast(lists.sparkSession.createDataFrame([(r["__sig"],) for r in found], "__sig long"))
        hot, cold = lists.join(keys, "__sig"), lists.join(keys, "__sig", "left_anti")
        parts.append(hot.join(F.broadcast(hot.groupBy("__sig").agg(*(f.alias(name) for name, f in facts.items()))), "__sig"))
    parts.append(cold.withColumns({name: f.over(over) for name, f in facts.items()}))
    wanted = ["__sig", "__node", "__n", "__own", "__label", "__group", "__c", "__s.__head", "__s.__hn"]
    kept = [p.filter("__lo <> __hi").select(*wanted) for p in parts]
    return kept[0].union(kept[1]) if len(kept) > 1 else kept[0]


#: What a pair of a head and another set carries along: the head's size, the other's, and how many counted shingles that shares with nobody.
CARRIED = {"__hn": T.IntegerType(), "__n": T.IntegerType(), "__own": T.LongType()}


def _nothing() -> list:
    """CARRIED, for rows that have none of it."""
    return [F.lit(None).cast(kind).alias(name) for name, kind in CARRIED.items()]


def compared(pairs: DataFrame, texts: DataFrame, words: int, fields: list, rows_of) -> DataFrame:
    """The rows (fields) that rows_of(set of __a, set of __b, values of the pair) makes of each of pairs (__a, __b, ..)."""
    more = [f for f in pairs.schema.fields if f.name not in ("__a", "__b")]
    names = [f.name for f in more]
    salts = pairs.groupBy("__a").agg(F.count("*").alias("__c")).withColumn("__salts", F.ceil(F.col("__c") / SALT_ROWS).cast("int")).drop("__c")
    members = pairs.join(salts, "__a").select("__a", F.pmod(F.xxhash64("__b"), F.col("__salts")).cast("int").alias("__salt"), "__b", *names)
    heads = salts.select("__a", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1)).alias("__salt"), F.lit(None).cast("long").alias("__b"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in more))
    asked = members.withColumn("__node", F.col("__b")).union(heads.withColumn("__node", F.col("__a")))
    joined = texts.join(asked.hint("shuffle_hash"), "__node").select("__a", "__salt", "__b", "__text", *names)
    dealt = joined.repartition("__a", "__salt").sortWithinPartitions("__a", "__salt", F.col("__b").asc_nulls_first())
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        own = head = None
        for batch in batches:
            for a, salts, b, texts, *carried in chunks(batch, 3):
                got: list[tuple] = []
                for x, salt, y, h, *values in zip(a, salts, b, shingle_sets(texts, words), *carried, strict=True):
                    if y is None:
                        own, head = h, (x, salt)
                        continue
                    if head != (x, salt):
                        raise ValueError(f"no text for the set {x}")
                    got += rows_of(own, h, x, y, *values)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], type=f.type) for k, f in enumerate(arrow)], schema=arrow)

    return dealt.mapInArrow(run, schema)


def _fields(**kinds) -> list:
    return [T.StructField(name, kind) for name, kind in kinds.items()]


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """pairs (__a, __b, __star, and CARRIED) with __link, whether the sets of their texts reach the threshold, and __far.

    A star's set is near its head or far from it; a star on the border has a row for each. Stars of very unlike sizes are far, whatever their texts.
    """
    border = NEAR - (100 - percent) / 100 - 1e-9
    less, more = F.least("__hn", "__n"), F.greatest("__hn", "__n")
    apart = F.coalesce(F.col("__star") & (less < (1 - NEAR) * more) & (100 * less.cast("long") < percent * more.cast("long")), F.lit(False))

    def rows_of(own, h, a, b, star, *carried):
        unlike = len(np.setxor1d(own, h, assume_unique=True))
        both = (len(own) + len(h) - unlike) // 2
        gap = unlike / (unlike + both)
        link = 100 * both >= percent * (both + unlike)
        near = [(a, b, star, link, False, *carried)] if gap <= NEAR or not star else []
        return near + ([(a, b, star, link, True, *carried)] if gap > border and star else [])

    fields = _fields(__a=T.LongType(), __b=T.LongType(), __star=T.BooleanType(), __link=T.BooleanType(), __far=T.BooleanType(), **CARRIED)
    told = pairs.filter(apart).select("__a", "__b", "__star", F.lit(False).alias("__link"), F.lit(True).alias("__far"), *CARRIED)
    return compared(pairs.filter(~apart), texts, words, fields, rows_of).union(told)


def differences(groups: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """groups (__head, __far, __node, and CARRIED) with __delta: what a near set differs in from the head, or a far one's whole set."""

    def rows_of(own, h, a, b, far, *carried):
        return [(a, b, far, *carried, (h if far else np.setxor1d(own, h, assume_unique=True)).view(np.int64))]

    fields = _fields(__head=T.LongType(), __node=T.LongType(), __far=T.BooleanType(), **CARRIED, __delta=T.ArrayType(T.LongType()))
    return compared(groups.select(F.col("__head").alias("__a"), F.col("__node").alias("__b"), "__far", *CARRIED), texts, words, fields, rows_of)


def difference_lists(groups: DataFrame, percent: int, shelf: Shelf) -> tuple[DataFrame, DataFrame]:
    """Lists (__sig, __node, __n, __own, __group) of sets that may link, from groups of sets (__head, __far, __hn, __node, __n, __own) and their __delta.

    Also (__group, __node, __e, __counts): the size of each difference, and of the part that others of the group share the counts by BUCKETS.
    """
    rows = groups.withColumn("__e", F.size("__delta")).filter("__e > 0")
    group, key = ["__head", "__far"], ["__head", "__far", "__node"]
    tokens = rows.select(*key, F.explode("__delta").alias("__t"))
    counts = tokens.groupBy(*group, "__t").agg(F.count("*").alias("__df")).filter("__df > 1")  # partial counts first: a hot head is no hot task
    ranked = keyed_join(tokens, counts, [*group, "__t"], "__df", groups.count())
    bucket = F.pmod("__t", F.lit(BUCKETS))
    lanes = [F.expr(f"sum(CASE __bucket WHEN {b} THEN 1L WHEN {b + 1} THEN {1 << 16}L WHEN {b + 2} THEN {1 << 32}L ELSE 0L END)") for b in range(0, BUCKETS, 3)]
    shared = ranked.withColumn("__bucket", bucket).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("__df", "__t"))).alias("__shared"), F.array(*lanes).alias("__counts"))
    rows = shelf.put("shared", rows.drop("__delta").join(shared, key).withColumn("__group", F.xxhash64(*group)))
    step = np.log(100 / percent) / 4
    reach = F.expr(f"cast(floor(__n * {100 - percent} / {percent}) AS int)")  # most a partner may differ in: it has at most n / t shingles
    parts = rows.select("__group", "__node", "__e", F.when(F.size("__shared") <= _LOWEST, F.col("__counts")).alias("__counts"))
    rows = rows.withColumns({"__reach": reach, "__w": F.expr(f"greatest(1, cast(floor(__hn * {100 - percent} / {4 * percent}) AS int))")})
    band = lambda x: f"IF(__far, cast(floor(ln({x}) / {step}) AS int), cast({x} / __w AS int))"  # noqa: E731  bands of equal width, or of equal ratio
    rows = rows.withColumn("__mine", F.expr(band("__e"))).withColumn("__other", F.explode(F.expr(f"sequence({band('greatest(1, __e - __reach)')}, {band('(__e + __reach)')})")))
    least = f"greatest(1, IF(__far, cast(floor(exp(__other * {step}) - 1e-6) AS int), __other * __w))"  # a partner of that band differs in no fewer
    rows = rows.withColumn("__least", F.expr(f"greatest(1, cast(ceil((__e + {least} - __reach) / 2) AS int))"))
    rows = rows.withColumn("__keep", F.expr("size(__shared) - __least + 1")).filter("__keep > 0")
    entries = rows.select("__group", "__node", "__n", "__own", F.least("__mine", "__other").alias("__b1"), F.greatest("__mine", "__other").alias("__b2"), F.explode(F.expr("slice(__shared, 1, __keep)")).alias("__s"))
    return entries.select(F.xxhash64("__group", "__b1", "__b2", "__s.__t").alias("__sig"), "__node", "__n", "__own", "__group"), parts


def small_pairs(lists: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """(__a, __b) of the pairs in one list whose differences from one set leave room for a link."""
    rows = lists.join(parts, ["__group", "__node"]).groupBy("__sig").agg(F.collect_list(F.struct("__node", "__n", "__label", "__e", "__counts")).alias("__all"))

    def least(x, y):  # of each two counts in the lanes of two longs
        over = (x.bitwiseOR(F.lit(_TOP)) - y).bitwiseAND(F.lit(_TOP))
        mask = over - F.shiftrightunsigned(over, 15)
        return y.bitwiseAND(mask).bitwiseOR(x.bitwiseAND(F.bitwise_not(mask)))

    def may_link(x, y):
        lanes = F.aggregate(F.zip_with(x["__counts"], y["__counts"], least), F.lit(0).cast("long"), lambda s, v: s + v)
        shared = sum((F.shiftrightunsigned(lanes, 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(3)), F.lit(0))  # no less than the overlap
        room = (100 + percent) * (x["__e"] + y["__e"] - 2 * shared) <= (100 - percent) * (x["__n"] + y["__n"])
        return (y["__node"] > x["__node"]) & (y["__label"] != x["__label"]) & F.coalesce(room, F.lit(True))

    of_one = lambda x: F.transform(F.filter("__all", lambda y: may_link(x, y)), lambda y: F.struct(x["__node"].alias("__a"), y["__node"].alias("__b")))
    return rows.select(F.explode(F.flatten(F.transform("__all", of_one))).alias("p")).select("p.__a", "p.__b").distinct()


def _links(open_lists: DataFrame, texts: DataFrame, words: int, percent: int, shelf: Shelf) -> DataFrame | None:
    """(__node, __label) of all classes that link with another one. open_lists: rows of with_heads over the index.

    Every table of a round is deleted once those made from it are written.
    """
    labels = parts = None
    while open_lists.count():
        stars = open_lists if parts is None else open_lists.filter(F.col("__c") > SMALL)
        pairs = stars.filter("__node <> __head").select(F.col("__head").alias("__a"), F.col("__node").alias("__b"), F.lit(True).alias("__star"), *CARRIED).distinct()
        if parts is not None:
            pairs = pairs.union(small_pairs(open_lists.filter(F.col("__c") <= SMALL), parts, percent).select("__a", "__b", F.lit(False).alias("__star"), *_nothing()))
        done = shelf.put("verified", verified(shelf.put("pairs", pairs), texts, words, percent))
        shelf.drop("pairs", "shared")
        labels = _relabelled(labels, done.filter("__link").select("__a", "__b"), shelf)
        if parts is not None and stars.isEmpty():
            break
        met = done.filter("__star").select(F.col("__a").alias("__head"), F.col("__b").alias("__node"), "__far", F.lit(0).alias("__band"), *CARRIED)
        groups = shelf.put("groups", _open_groups(met, labels, done.count(), shelf))
        shelf.drop("verified", "facts")
        fits = (F.col("__size") <= BLOCK) & (F.col("__mass") <= BLOCK_SHINGLES)
        inside, rest = groups.filter(fits), groups.filter(~fits).drop("__size", "__mass")
        if large := rest.count():  # sets that link lie in one family of sizes or in neighbouring ones, so they share a band
            family = F.floor(F.ln("__n") / (np.log(100 / percent) * (1 + 1e-9))).cast("int") + 1
            rest = rest.withColumn("__band", F.explode(F.array(family, family + 1)))
            bands = shelf.put("bands", _open_groups(rest, labels, 2 * large, shelf))
            shelf.drop("facts")
            inside, rest = inside.unionByName(bands.filter(fits)), bands.filter(~fits).drop("__size", "__mass")
        inside = shelf.put("inside", block_links(inside, labels, texts, words, percent))
        labels = _relabelled(labels, inside, shelf)
        shelf.drop("inside", "groups")
        if not large or rest.isEmpty():
            shelf.drop("bands")
            break
        groups = shelf.put("differences", differences(rest.drop("__band").distinct(), texts, words))
        shelf.drop("bands")
        lists, parts = difference_lists(groups, percent, shelf)
        shelf.drop("differences")
        lists = shelf.put("lists", lists.join(labels, "__node", "left").withColumn("__label", F.coalesce("__label", "__node")))
        open_lists = shelf.put("open", with_heads(lists))
        shelf.drop("lists")
        texts = shelf.put("texts", texts.join(open_lists.select("__node").union(open_lists.select("__head")).distinct(), "__node", "left_semi"))
    return labels


def _relabelled(labels: DataFrame | None, links: DataFrame, shelf: Shelf) -> DataFrame:
    """labels (__node, __label) with further links (__a, __b): only links between labels take part."""
    named = lambda df: df.select(F.col("node").alias("__node"), F.col("root").alias("__label"))
    if labels is None:
        labels = shelf.put("labels", named(components(links, "__a", "__b", shelf)))
        shelf.drop("edges")
        return labels
    for side in ("__a", "__b"):
        links = links.join(labels.withColumnRenamed("__node", side), side, "left").withColumn(side, F.coalesce("__label", side)).drop("__label")
    links = shelf.put("links", links.filter("__a <> __b").distinct())
    if not links.isEmpty():
        roots = named(components(links, "__a", "__b", shelf))
        moved = labels.join(roots.select(F.col("__node").alias("__label"), F.col("__label").alias("__root")), "__label", "left").select("__node", F.coalesce("__root", "__label").alias("__label"))
        labels = shelf.put("labels", moved.union(roots.join(labels, "__node", "left_anti")))
    shelf.drop("links", "edges")
    return labels


def _open_groups(rows: DataFrame, labels: DataFrame, total: int, shelf: Shelf) -> DataFrame:
    """Rows of the groups (__head, __far, __band) that hold several labels, with the group's number of sets __size and of their shingles __mass."""
    key = ["__head", "__far", "__band"]
    labelled = rows.join(labels, "__node", "left").withColumn("l", F.coalesce("__label", "__node"))
    facts = labelled.groupBy(*key).agg(F.count("*").alias("__size"), F.sum("__n").alias("__mass"), F.min("l").alias("lo"), F.max("l").alias("hi"))
    facts = shelf.put("facts", facts.filter("lo <> hi").select(*key, "__size", "__mass"))
    return keyed_join(rows, facts, key, "__size", total)


def connecting_links(nodes: list[int], labels: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what the labels leave apart, as many as it takes and no more."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sets, nodes = [sets[i] for i in order], [nodes[i] for i in order]
    comp = np.unique(np.array([labels[i] for i in order]), return_inverse=True)[1]
    n = np.array([len(h) for h in sets])
    parts = np.uint64(1 << int(np.clip(int(np.median(n)) - 1, 63, 2047)).bit_length())
    counts = np.stack([np.bincount((h & (parts - np.uint64(1))).astype(np.int64), minlength=int(parts)).astype(np.uint16) for h in sets])
    most = np.searchsorted(n, n * 100 // percent, side="right")  # a partner has at most so many shingles
    out = []
    for i in range(len(sets) - 1):
        j = np.arange(i + 1, most[i])
        j = j[comp[j] != comp[i]]
        if not len(j):
            continue
        bound = np.minimum(counts[i], counts[j]).sum(1, dtype=np.int64)
        may = (100 + percent) * bound >= percent * (n[i] + n[j])
        for k in j[may][np.argsort(-bound[may], kind="stable")].tolist():
            if comp[k] != comp[i] and (100 + percent) * len(np.intersect1d(sets[i], sets[k], assume_unique=True)) >= percent * (n[i] + n[k]):
                out.append((nodes[i], nodes[k]))
                comp[comp == comp[k]] = comp[i]
    return out


def block_links(groups: DataFrame, labels: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(__a, __b): links between labels inside groups of at most BLOCK sets."""
    key = ["__head", "__far", "__band"]
    known = groups.select(*key, "__node").join(labels, "__node", "left").withColumn("__label", F.coalesce("__label", "__node"))
    dealt = known.join(texts, "__node").select(*key, "__node", "__label", "__text").repartition(*key).sortWithinPartitions(*key)
    schema = T.StructType([T.StructField("__a", T.LongType()), T.StructField("__b", T.LongType())])

    def run(batches):
        group, held = None, ([], [], [])

        def links():
            found = connecting_links(*held, percent) if len(held[0]) > 1 else []
            for column in held:
                column.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], type=pa.int64()) for k in (0, 1)], names=["__a", "__b"])

        for batch in batches:
            for heads, fars, bands, nodes, labels, texts in chunks(batch, 5):
                for key, node, label, h in zip(zip(heads, fars, bands, strict=True), nodes, labels, shingle_sets(texts, words), strict=True):
                    if key != group:
                        yield links()
                        group = key
                    for column, v in zip(held, (node, label, h), strict=True):
                        column.append(v)
        yield links()

    return dealt.mapInArrow(run, schema)


def jaccard_components(docs: DataFrame, percent: int = 85, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, __n (set size) and __component (smallest id reachable by links)."""
    shelf = Shelf(docs.sparkSession)
    sets = shelf.put("sets", set_table(docs, id_col, text_col, words))
    members = sets.filter("__h IS NULL").drop("__h", "__c")
    sizes = members.agg(F.count("*").alias("n"), F.count_if(F.col("__id").isNull() & (F.col("__n") > 0)).alias("nulls")).collect()[0]
    if not sizes["n"]:
        return members.select(F.col("__id").alias(id_col), "__n", F.col("__id").alias("__component"))
    entries = shelf.put("index", index_table(docs, id_col, text_col, words, percent, frequent_shingles(sets, sizes["n"])))
    lists = shelf.put("open", with_heads(entries.withColumns({"__label": F.col("__node"), "__group": F.lit(None).cast("long")})))
    shelf.drop("index")
    wanted = lists.select("__node").distinct()
    owners = members.join(wanted, "__node").groupBy("__node").agg(F.min(F.when(F.col("__id").isNotNull(), F.struct("__id"))).alias("s")).select("__node", F.col("s.__id").alias("__id"))
    rows = _rows(docs, id_col, text_col).filter(F.col("__text").isNotNull())
    found = rows.join(owners.hint("shuffle_hash"), "__id").select("__node", "__text")
    if sizes["nulls"]:  # classes without any id find their text by its set
        nameless = owners.filter("__id IS NULL").select("__node")
        found = found.union(_keyed(rows.filter("__id IS NULL"), words).join(nameless, "__node").dropDuplicates(["__node"]))
    labels = _links(lists, shelf.put("texts", _of_set(found, words)), words, percent, shelf)
    shelf.drop_but("sets", "labels")
    node = members.filter("__n > 0").groupBy("__node").agg(F.min("__id").alias("__least"))
    if labels is not None:
        node = node.join(labels, "__node", "left").withColumn("__label", F.coalesce("__label", "__node"))
        least = node.groupBy("__label").agg(F.min("__least").alias("__component"))
        node = node.join(least, "__label").select("__node", "__component")
    else:
        node = node.withColumnRenamed("__least", "__component")
    named = members.join(node, "__node", "left")
    component = F.when(F.col("__n") > 0, F.col("__component")).otherwise(F.col("__id"))
    return named.select(F.col("__id").alias(id_col), "__n", component.alias("__component"))


def _keyed(rows: DataFrame, words: int) -> DataFrame:
    """(__node, __text) of rows' texts, one for each set and task."""
    schema = T.StructType([T.StructField("__node", T.LongType()), rows.schema["__text"]])
    arrow = to_arrow_schema(schema)

    def run(batches):
        seen = set()
        for batch in batches:
            for _, texts in chunks(batch):
                kept = []
                for t, h in zip(texts, shingle_sets(texts, words), strict=True):
                    if len(h) and (node := set_key(h)) not in seen:
                        seen.add(node)
                        kept.append((node, t))
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in kept], type=f.type) for k, f in enumerate(arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)


def _of_set(found: DataFrame, words: int) -> DataFrame:
    """(__node, __text) of the texts whose set is their node's (an id may name several rows), one for each node and task."""
    schema = found.schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        seen = set()
        for batch in batches:
            for nodes, texts in chunks(batch):
                kept = []
                for node, t, h in zip(nodes, texts, shingle_sets(texts, words), strict=True):
                    if node in seen:
                        continue
                    if set_key(h) == node:
                        seen.add(node)
                        kept.append((node, t))
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in kept], type=f.type) for k, f in enumerate(arrow)], schema=arrow)

    return found.mapInArrow(run, schema)


def jaccard_report(docs: DataFrame) -> DataFrame:
    """Set size and component of every document, at a Jaccard similarity of 0.85 over four-word shingles."""
    return jaccard_components(docs).select("doc_id", F.col("__n").alias("n_shingles"), F.col("__component").alias("component_id"))
