"""Line dedup by winnowing over line hashes.

A text's lines (cut at line feeds, stripped of ASCII white space, blank ones left out) are hashed. A k-gram starts at each line and
takes lines until it holds `gram_words` words; a window starts at each line and takes lines until it holds `window_words`. Of the k-grams inside
each window the one with the smallest hash (the last of equals) is selected, so any run of lines of `window_words` words that two texts
share has a selected k-gram in common, and nothing shorter than `gram_words` words ever matches. Selected positions are joined with the
first position (smallest id, then line) of the same k-gram, each match is extended both ways line by line, and the lines of the later
run are deleted. Runs inside one text count too, if they don't overlap their first copy.

The first position of a k-gram may have less around it than another earlier one. So where a k-gram has three positions or more, the
windows around it, which start or end at each line, are joined too, each with its own first position, and extended in the same way. A run
of `window_words` words or more that a text shares with any earlier one consists of such windows, so it goes as a whole.

Only (hash, id, position) triples are shuffled for the joins, and line hashes for the extension; first positions come from a partial
aggregation, hot k-grams meet theirs by broadcast, and a text with many copies is dealt to a group for each COPIES of them.

Defined cases: null text stays null; texts without lines stay as they are; ids may have any type that can be ordered, null ones come
first; rows that share an id are different texts, ordered by their text's hash; rows equal in id and text are one document, and all lose
the same lines; exact copies with other ids keep their first text and lose all matched lines elsewhere; deleting all lines leaves an empty
text; an empty table gives an empty result; further columns stay, but for names with two leading underscores, which are taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tremor.llm.common import POWERS, keyed_join, map_texts, materialize, mix64, span_hashes, spans_of

GRAM_WORDS = 25
WINDOW_WORDS = 50
#: Copies that one group extends against an earlier text.
COPIES = 64

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def line_table(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line that is not blank: its number among all lines, its hash and its words."""
    none = np.empty(0, dtype=np.int64)
    if not text:
        return none, none.astype(np.uint64), none
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    white = _WHITE[data]
    first, last = spans_of(~white)
    if not len(first):
        return none, none.astype(np.uint64), none
    ends = np.flatnonzero(data == 10)
    line = np.searchsorted(ends, first)
    head = np.flatnonzero(np.diff(line, prepend=-1))
    tail = np.append(head[1:], len(line)) - 1
    return line[head], span_hashes(data, first[head], last[tail]), tail - head + 1


def fingerprints(hashes: np.ndarray, words: np.ndarray, gram_words: int, window_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Selected positions (indices of lines) and the hashes of their k-grams."""
    n = len(hashes)
    none = np.empty(0, dtype=np.int64)
    total = np.concatenate(([0], np.cumsum(words)))
    if not n or total[-1] < gram_words:
        return none, none.astype(np.uint64)
    ends = np.searchsorted(total, total[:-1] + gram_words)  # k-gram i is the lines i to ends[i] - 1
    starts = np.flatnonzero(ends <= n)
    ends = ends[starts]
    weight = mix64(np.arange(1, int((ends - starts).max()) + 1, dtype=np.uint64))
    grams = np.zeros(len(starts), dtype=np.uint64)
    for k in range(len(weight)):  # k-grams are a few lines; long ones are rare
        on = starts + k < ends
        if not on.any():
            break
        grams[on] += hashes[starts[on] + k] * (weight[k] | np.uint64(1))
    grams = mix64(grams)
    stop = np.searchsorted(total, total[:-1] + window_words)
    wins = np.flatnonzero(stop <= n)
    if not len(wins):
        return none, none.astype(np.uint64)
    last = np.searchsorted(ends, stop[wins], side="right") - 1  # the last k-gram that ends inside the window
    chosen = set()
    values = grams.tolist()
    for i, j in zip(wins.tolist(), last.tolist(), strict=True):
        best = i
        for k in range(i, j + 1):
            if values[k] <= values[best]:
                best = k
        chosen.add(best)
    at = np.array(sorted(chosen), dtype=np.int64)
    return at, grams[at]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def windows_around(hashes: np.ndarray, words: np.ndarray, at: np.ndarray, gram_words: int, window_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows, from each line on and up to each line, that hold one of the k-grams at some positions."""
    n = len(hashes)
    total = np.concatenate(([0], np.cumsum(words)))
    stop = np.searchsorted(total, total[:-1] + window_words)
    lines = np.flatnonzero(stop <= n)
    start = np.searchsorted(total, total[1:] - window_words, side="right") - 1
    ends = np.flatnonzero(start >= 0)
    ends = ends[stop[start[ends]] != ends + 1]  # those that are not among the others
    lo, hi = np.concatenate([lines, start[ends]]), np.concatenate([stop[lines], ends + 1])
    gram_end = np.searchsorted(total, total[at] + gram_words)
    first = np.searchsorted(at, lo)  # the first k-gram that starts in the window also ends first
    held = (first < len(at)) & (np.append(gram_end, n + 1)[first] <= hi)
    lo, hi = lo[held], hi[held]
    up, down = POWERS.get(n + 1)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(hashes * up[:n], dtype=np.uint64)))
    keys = mix64((sums[hi] - sums[lo]) * down[lo] + mix64((hi - lo).astype(np.uint64)))
    return lo, keys.view(np.int64)


def _later(places: DataFrame, firsts: DataFrame, key: str, total: int) -> DataFrame:
    """(__doc, __other, __mine, __theirs): places after the first one of their key."""
    joined = keyed_join(places, firsts, [key], "__n", total).filter(F.struct("__doc", "__at") > F.col("__first"))
    return joined.select("__doc", F.col("__first.__doc").alias("__other"), F.col("__at").alias("mine"), F.col("__first.__at").alias("theirs"))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """__doc (the id and the text's hash) and the indices of its lines that repeat an earlier run, as __runs of (lo, hi)."""
    rows = docs.filter(F.col(text_col).isNotNull()).select(_document(id_col, text_col), F.col(text_col).alias("__text"))
    longs, doc = T.ArrayType(T.LongType()), rows.schema["__doc"]
    schema = T.StructType([doc, T.StructField("__lines", longs), T.StructField("__words", T.ArrayType(T.IntegerType())), T.StructField("__at", longs), T.StructField("__gram", longs)])

    def run(keys, texts):
        lines, counts, places, grams = [], [], [], []
        for t in texts:
            _, hashes, words = line_table(t)
            at, gram = fingerprints(hashes, words, gram_words, window_words)
            lines.append(_signed(hashes) if len(at) else None)
            counts.append(words.astype(np.int32) if len(at) else None)
            places.append(at)
            grams.append(_signed(gram))
        return {"__doc": keys, "__lines": lines, "__words": counts, "__at": places, "__gram": grams}

    lined = materialize(map_texts(rows, run, schema).filter(F.size("__at") > 0).dropDuplicates(["__doc"]), "lines")  # read several times below
    marks = lined.select("__doc", F.explode(F.arrays_zip("__at", "__gram")).alias("m")).select("__doc", F.col("m.__at").alias("__at"), F.col("m.__gram").alias("__gram"))
    first = [F.min(F.struct("__doc", "__at")).alias("__first"), F.count("*").alias("__n")]
    firsts = materialize(marks.groupBy("__gram").agg(*first).filter("__n > 1"), "firsts")
    total = marks.count()
    again = keyed_join(marks, firsts.filter("__n > 2").select("__gram", "__n"), ["__gram"], "__n", total).groupBy("__doc").agg(F.sort_array(F.collect_list("__at")).alias("__at"))
    spread = T.StructType([doc, T.StructField("__at", longs), T.StructField("__window", longs)])

    def windows(batches):
        arrow = to_arrow_schema(spread)
        for batch in batches:
            made = []
            for lines, words, at in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                arrays = (x.values.to_numpy(zero_copy_only=False) for x in (lines, words, at))
                made.append(_windows(*arrays, gram_words, window_words))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field("__doc").type), *(pa.array([m[k] for m in made], type=arrow.field(k + 1).type) for k in (0, 1))], schema=arrow)

    wide = lined.select("__doc", "__lines", "__words").join(again, "__doc").select("__doc", "__lines", "__words", "__at").mapInArrow(windows, spread)
    wide = materialize(wide, "windows").select("__doc", F.explode(F.arrays_zip("__at", "__window")).alias("m")).select("__doc", F.col("m.__at").alias("__at"), F.col("m.__window").alias("__window"))
    found = _later(marks, firsts, "__gram", total).union(_later(wide, materialize(wide.groupBy("__window").agg(*first).filter("__n > 1"), "firsts"), "__window", total))
    # places of one shift lie in one run more often than not: a run is extended once
    pairs = materialize(found.groupBy("__doc", "__other").agg(F.collect_set(F.struct("mine", "theirs")).alias("__places")), "pairs")
    salts = pairs.groupBy("__other").agg(F.ceil(F.count("*") / COPIES).cast("int").alias("__salts"))
    dealt = lined.select(F.col("__doc").alias("__other"), F.col("__lines").alias("__theirs")).join(salts, "__other").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1)))
    mine = lined.select("__doc", F.col("__lines").alias("__mine")).join(keyed_join(pairs, salts.withColumn("__n", F.col("__salts") * COPIES), ["__other"], "__n", total).withColumn("__salt", F.pmod(F.xxhash64("__doc"), F.col("__salts")).cast("int")).drop("__salts", "__n"), "__doc")
    sides = mine.join(dealt.drop("__salts"), ["__other", "__salt"])
    out = T.StructType([doc, T.StructField("__runs", T.ArrayType(longs))])
    cols = ["__doc", "__mine", "__theirs", "__places", (F.col("__doc") == F.col("__other")).alias("__same")]

    def extend(batches):
        arrow = to_arrow_schema(out)
        for batch in batches:
            runs = []
            for mine, theirs, places, same in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                runs.append(extend_matches(mine, theirs, [(p["mine"], p["theirs"]) for p in places], same))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field("__doc").type), pa.array(runs, type=arrow.field("__runs").type)], schema=arrow)

    runs = sides.select(*cols).mapInArrow(extend, out)
    return runs.groupBy("__doc").agg(F.array_distinct(F.flatten(F.collect_list("__runs"))).alias("__runs")).filter(F.size("__runs") > 0)


def _document(id_col: str, text_col: str):
    """What tells documents apart, in their order."""
    return F.struct(F.col(id_col).isNotNull().alias("has"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text")).alias("__doc")


def _windows(lines: np.ndarray, words: np.ndarray, at: np.ndarray, gram_words: int, window_words: int) -> tuple[np.ndarray, np.ndarray]:
    return windows_around(lines.view(np.uint64), words.astype(np.int64), np.asarray(at), gram_words, window_words)


def extend_matches(mine: list[int], theirs: list[int], places: list[tuple[int, int]], same: bool) -> list[list[int]]:
    """Maximal equal runs around matched positions, as [lo, hi) of mine; inside one text a run stops short of its copy."""
    runs: list[list[int]] = []
    reach: dict[int, int] = {}
    for i, j in sorted(places):
        if reach.get(i - j, -1) > i:  # inside a run of the same shift
            continue
        lo, hi = i, i
        room = i - j if same else max(len(mine), len(theirs))
        while hi < len(mine) and hi - i + j < len(theirs) and mine[hi] == theirs[hi - i + j] and hi - lo < room:
            hi += 1
        while lo > 0 and lo - i + j > 0 and mine[lo - 1] == theirs[lo - 1 - i + j] and hi - lo < room:
            lo -= 1
        reach[i - j] = hi
        if hi > lo:
            runs.append([lo, hi])
    return runs


def remove_lines(text: str | None, runs: list | None) -> tuple[str | None, int, int]:
    """The text without the lines of the runs (counted among lines that are not blank); lines there were, lines deleted."""
    if not text:
        return text, 0, 0
    lines = text.split("\n")
    kept = [k for k, x in enumerate(lines) if x.strip(" \t\n\r\x0b\x0c")]
    if not runs:
        return text, len(kept), 0
    gone = {kept[k] for lo, hi in runs for k in range(lo, min(hi, len(kept)))}
    return "\n".join(x for k, x in enumerate(lines) if k not in gone), len(kept), len(gone)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """docs with text_col cleaned, and __n_lines and __n_deleted."""
    runs = repeated_runs(docs, id_col, text_col, gram_words, window_words)
    joined = docs.withColumn("__doc", _document(id_col, text_col)).join(runs, "__doc", "left").drop("__doc")
    fields = [T.StructField("__clean", T.StringType()), T.StructField("__n_lines", T.LongType()), T.StructField("__n_deleted", T.LongType())]
    return _cleaned(joined, docs.columns, text_col, fields)


def _cleaned(joined: DataFrame, columns: list[str], text_col: str, fields: list) -> DataFrame:
    kept = [f for f in joined.schema.fields if f.name != "__runs"]
    schema = T.StructType([*(f for f in kept if f.name != text_col), *fields])
    arrow = to_arrow_schema(schema)
    names = joined.columns

    def run(batches):
        for batch in batches:
            texts, runs = batch.column(names.index(text_col)), batch.column(names.index("__runs"))
            step = 256  # texts held as Python strings at a time
            for at in range(0, batch.num_rows, step):
                made = [remove_lines(t, r) for t, r in zip(texts.slice(at, step).to_pylist(), runs.slice(at, step).to_pylist(), strict=True)]
                piece = batch.slice(at, step)
                old = [piece.column(names.index(f.name)) for f in kept if f.name != text_col]
                new = [pa.array([m[k] for m in made]) for k in range(3)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*old, *new], arrow, strict=True)], schema=arrow)

    done = joined.mapInArrow(run, schema)
    return done.select(*(F.col("__clean").alias(text_col) if c == text_col else F.col(c) for c in columns), "__n_lines", "__n_deleted")


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """Each document's cleaned text with the lines it had and lost."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "text", F.col("__n_lines").alias("n_lines"), F.col("__n_deleted").alias("n_deleted"))
