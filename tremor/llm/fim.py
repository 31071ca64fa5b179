"""Fill-in-the-middle transformation by one numpy kernel over the UTF-8 buffers of a whole Arrow batch.

A text is cut into units, runs of the letters A-Z and a-z or single other characters. Two cuts make a prefix, a middle and a suffix, which are
written as prefix-suffix-middle (psm) or suffix-prefix-middle (spm) behind markers, or the text stays plain. The draws come from a SHA-256 of
the seed and the row's key, so a row's form doesn't depend on its neighbours, partitions or retries.

The kernel holds no row in Python. A byte-class table tells letters, other first bytes and continuation bytes apart; comparing neighbouring
bytes marks where units start; sums of the marks, less what they were at the row's first byte, number the units of all rows at once; and
searchsorted finds the bytes of all cuts. The parts of a row are neighbours in the buffer, so they are Arrow strings over it without
a copy, and Arrow joins them with the markers.

Defined cases: null text counts as empty; empty texts, and texts that hold a marker, stay plain; a null key is an empty key; repeated rows
repeat; of an empty table nothing is made; further columns stay, whatever their names. A batch is taken in pieces of about PIECE bytes,
a longer text in one piece of its own (about 16 bytes of memory for each of its bytes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MARKERS = ("<P>", "<S>", "<M>")
#: Rows of 100 that stay plain, and of the others those of 100 that are written suffix first.
PLAIN, SPM = 10, 20
PIECE = 4_000_000

_LETTER, _FIRST, _REST = 1, 2, 0
_CLASS = np.full(256, _FIRST, dtype=np.uint8)
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[128:192] = _REST
_NAME = np.zeros(256, dtype=bool)
_NAME[[ord(m[1]) for m in MARKERS]] = True


def _sums(marks: np.ndarray) -> np.ndarray:
    """How many marks lie before each place, and before the end."""
    out = np.zeros(len(marks) + 1, dtype=np.int32)
    np.cumsum(marks, out=out[1:])
    return out


def cuts_of(data: np.ndarray, bounds: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> dict[str, np.ndarray]:
    """Of rows data[bounds[i]:bounds[i + 1]] of UTF-8: units n, bytes where prefix and middle end, characters of both, and whether a marker is there."""
    first, last = bounds[:-1], bounds[1:]
    kind = _CLASS[data]
    starts = kind == _FIRST
    letters = kind == _LETTER
    starts[1:] |= letters[1:] & ~letters[:-1]
    filled = first[first < last]
    starts[filled] |= letters[filled]
    units = _sums(starts)
    n = (units[last] - units[first]).astype(np.int64)
    a, b = h1 % (n + 1), h2 % (n + 1)

    def place(k: np.ndarray) -> np.ndarray:  # where unit k of its row starts, or the row ends
        found = np.searchsorted(units, (units[first] + k + 1).astype(np.int32), side="left") - 1
        return np.where(k < n, found, last)

    one, two = place(np.minimum(a, b)), place(np.maximum(a, b))
    chars = _sums(kind != _REST)
    marked = np.zeros(len(first), dtype=bool)
    if len(data) > 2:
        at = np.flatnonzero((data[:-2] == 60) & _NAME[data[1:-1]] & (data[2:] == 62))
        row = np.searchsorted(bounds, at, side="right") - 1
        marked[row[at + 2 < last[row]]] = True
    return {"n": n, "one": one, "two": two, "prefix": (chars[one] - chars[first]).astype(np.int64), "middle": (chars[two] - chars[one]).astype(np.int64), "marked": marked}


def transform(texts: pa.StringArray, h: list[np.ndarray], plain: int = PLAIN, spm: int = SPM) -> dict[str, pa.Array]:
    """The transformation of a whole array of texts without nulls; h: four arrays of draws."""
    rows = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + rows + 1].astype(np.int64)
    low = int(bounds[0])
    bounds -= low
    held = texts.buffers()[2]
    buffer = held.slice(low, int(bounds[-1])) if held is not None else pa.py_buffer(b"")
    cut = cuts_of(np.frombuffer(buffer, dtype=np.uint8), bounds, h[0], h[1])
    is_plain = (bounds[1:] == bounds[:-1]) | cut["marked"] | (h[2] % 100 >= 100 - plain)
    is_spm = ~is_plain & (h[3] % 100 < spm)
    edges = np.empty(3 * rows + 1, dtype=np.int32)
    edges[0:-1:3], edges[1::3], edges[2::3], edges[-1] = bounds[:-1], cut["one"], cut["two"], bounds[-1]
    parts = pa.Array.from_buffers(pa.string(), 3 * rows, [None, pa.py_buffer(edges), buffer])
    out, where = [texts], np.arange(rows)  # where: a row's place in the arrays of out, one after the other
    for k, (chosen, layout) in enumerate(((~is_plain & ~is_spm, (0, 2, 1)), (is_spm, (2, 0, 1))), 1):
        at = np.flatnonzero(chosen)
        pieces = [x for part in layout for x in (MARKERS[(0, 2, 1)[part]], parts.take(pa.array(3 * at + part)))]
        out.append(pc.binary_join_element_wise(*pieces, ""))
        where[at] = np.arange(len(at)) + sum(len(x) for x in out[:k])
    output = pa.chunked_array(out).combine_chunks().take(pa.array(where)) if rows else texts
    form = pa.array(np.array(["psm", "spm", "plain"], dtype=object)[np.where(is_plain, 2, np.where(is_spm, 1, 0))], type=pa.string())
    return {
        "__units": pa.array(cut["n"]), "__form": form, "__prefix_chars": pa.array(cut["prefix"], mask=is_plain), "__middle_chars": pa.array(cut["middle"], mask=is_plain), "__output": output,
    }


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about PIECE bytes."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // PIECE
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return ((a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b)


def with_draws(docs: DataFrame, id_col: str, seed: str) -> DataFrame:
    """docs with four draws from 0 to 2**32 - 1: the first four groups of eight digits of the SHA-256 of the seed, a colon and the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    hashed = docs.withColumn("__draws", digest)
    return hashed.withColumn("__draws", F.array(*(F.conv(F.substring("__draws", 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4))))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """docs with __units, __form (plain, psm, spm), __prefix_chars, __middle_chars (null if plain) and __output, without a shuffle."""
    drawn = with_draws(docs, id_col, seed)
    new = [T.StructField("__units", T.LongType()), T.StructField("__form", T.StringType()), T.StructField("__prefix_chars", T.LongType()), T.StructField("__middle_chars", T.LongType()), T.StructField("__output", T.StringType())]
    schema = T.StructType([*docs.schema.fields, *new])
    arrow = to_arrow_schema(schema)
    at, width = docs.columns.index(text_col), len(docs.columns)

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(at).cast(pa.string()), "")
            draws = batch.column(width).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            for a, b in _pieces(texts):
                made = transform(texts.slice(a, b - a), list(draws[a:b].T), plain, spm)
                columns = [*batch.slice(a, b - a).columns[:width], *made.values()]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return drawn.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from. Markers begin with < and the parts hold none, so none can arise where a part meets a marker."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))


def fim_report(docs: DataFrame) -> DataFrame:
    """Units, form, sizes of prefix and middle, and digests of the output and of the text rebuilt from it."""
    made = fill_in_middle(docs.select("doc_id", "text"))
    return made.select(
        "doc_id", F.col("__units").alias("n"), F.col("__form").alias("form"), F.col("__prefix_chars").alias("prefix_chars"), F.col("__middle_chars").alias("middle_chars"),
        F.sha2("__output", 256).alias("output_sha256"), F.sha2(restored(F.col("__output"), F.col("__form")), 256).alias("restored_sha256"),
    )


#: The same from SQL: units by a regular expression, parts as lists of units.
SQL = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n,
    ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y, ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS d
  FROM cut
), parts AS (
  SELECT doc_id, t, n,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS s
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
