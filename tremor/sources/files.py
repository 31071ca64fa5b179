"""File sources: recordings in MAT (level 5) and NPZ files, metadata tables, file digests; and a metadata template sink."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: numeric element types.
_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}


def _element(data: bytes, at: int, order: str) -> tuple[int, bytes, int]:
    """Type, payload and the position after an element."""
    kind, size = struct.unpack_from(order + "II", data, at)
    if kind >> 16:  # small form: size and type share a word
        return kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)], at + 8
    end = at + 8 + size
    return kind, data[at + 8 : end], end if kind == 15 else end + -size % 8


def read_mat(data: bytes, name: str = "tsDS") -> np.ndarray:
    """One numeric matrix of a level 5 MAT file, plain or compressed."""
    if len(data) < 128:
        raise ValueError("not a MAT file")
    order = "<" if data[126:128] == b"IM" else ">"
    at = 128
    while at + 8 <= len(data):
        kind, body, at = _element(data, at, order)
        if kind == 15:
            kind, body, _ = _element(zlib.decompress(body), 0, order)
        if kind != 14:
            continue
        _, flags, p = _element(body, 0, order)
        _, dims, p = _element(body, p, order)
        _, label, p = _element(body, p, order)
        if label.decode("latin-1").rstrip("\0") != name:
            continue
        if struct.unpack_from(order + "I", flags)[0] & 0x0800:
            raise ValueError("complex values are not accepted")
        number, values, _ = _element(body, p, order)
        if number not in _TYPES:
            raise ValueError("the variable is not numeric")
        shape = struct.unpack(order + f"{len(dims) // 4}i", dims)
        return np.frombuffer(values, dtype=order + _TYPES[number]).astype(np.float64).reshape(shape, order="F")
    raise ValueError(f"variable {name} is missing")


def _columns(content: bytes, path: str, variable: str, column: int) -> tuple[np.ndarray, np.ndarray]:
    if path.endswith(".npz"):
        with np.load(io.BytesIO(content)) as z:
            m = np.asarray(z[variable], dtype=np.float64)
    else:
        m = read_mat(content, variable)
    if m.ndim != 2 or m.shape[1] < 2 or not m.size:
        raise ValueError("a matrix of two columns or more is needed")
    if not 0 < column < m.shape[1]:
        raise ValueError("the signal column is out of range")
    return m[:, 0], m[:, column]


def recordings(spark: SparkSession, folder: str, variable: str = "tsDS", column: int = 1, glob: str = "*.mat") -> DataFrame:
    """(path, sha256, t, x, error): one row per file below the folder; what can't be read has an error and no arrays."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    digested = files.select("path", F.sha2("content", 256).alias("sha256"), "content")

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    rows.append((*_columns(content, path, variable, column), None))
                except (ValueError, KeyError, struct.error, zlib.error, OSError) as e:
                    rows.append((None, None, str(e) or type(e).__name__))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.list_(pa.float64())), pa.array([r[1] for r in rows], pa.list_(pa.float64())), pa.array([r[2] for r in rows], pa.string())],
                names=["path", "sha256", "t", "x", "error"],
            )

    return digested.mapInArrow(run, "path string, sha256 string, t array<double>, x array<double>, error string")


def metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    """A metadata table as text columns with normalised headers; numbers that can't be read are NULL."""
    raw = spark.read.option("header", "true").option("encoding", "UTF-8").csv(path)
    plain = raw.toDF(*["".join(ch for ch in c.lower().strip("﻿ \t") if ch.isalnum()) for c in raw.columns])
    number = lambda c: F.expr(f"CASE WHEN abs(try_cast({c} AS DOUBLE)) < double('inf') THEN try_cast({c} AS DOUBLE) END")
    have = lambda *names: next((n for n in names if n in plain.columns), None)
    text = lambda *names: F.nullif(F.trim(F.col(n)), F.lit("")) if (n := have(*names)) else F.lit(None).cast("string")
    value = lambda *names: number(n) if (n := have(*names)) else F.lit(None).cast("double")
    teeth = value("toothcount", "teeth", "flutes")
    return plain.select(
        text("recordingid", "id").alias("recording_id"), text("relativepath", "path", "file").alias("path"), value("rpm", "spindlespeed").alias("rpm"),
        F.when(teeth == F.floor(teeth), teeth.cast("int")).alias("tooth_count"), value("stickout", "ld").alias("stickout"), value("depthofcut", "doc", "docin").alias("depth_of_cut"),
        value("feedrate", "feed").alias("feed_rate"), text("toolidentifier", "tool").alias("tool_identifier"), text("label", "state").alias("label"),
    )


def metadata_template(files: DataFrame) -> DataFrame:
    """A row of blank metadata for each file."""
    blank = [F.lit(None).cast("string").alias(c) for c in ("rpm", "tooth_count", "stickout", "depth_of_cut", "feed_rate", "tool_identifier", "label", "repetition_id")]
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[A-Za-z0-9]+$", "")
    return files.select(F.col("path").alias("relative_path"), name.alias("recording_id"), *blank)


#: Bytes up to which a file is one row, which a task holds several times over; larger ones go in pieces of PIECE bytes.
WHOLE, PIECE = 1 << 26, 1 << 13
#: Names of files that Spark's text source would unpack: always one row each.
PACKED = ("bz2", "deflate", "gz", "lz4", "snappy", "zst")
_MARK = b"\xef\xbb\xbf"


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """SHA-256 and size of every file below a folder (Spark lists no empty files).

    Large files are read side by side, in ranges of bytes; their pieces then go in order through one task for each file, which holds a few of them at a
    time: SHA-256 can't be worked out in any other order.
    """
    read = lambda kind, names="*": spark.read.format(kind).option("recursiveFileLookup", "true").option("pathGlobFilter", names).option("lineSep", "\n").load(folder)
    of = lambda files: files.select("path", F.sha2("content", 256).alias("sha256"), "length")
    files, large = read("binaryFile"), F.col("length") > WHOLE
    names = files.filter(large).select("path", "length", F.col("_metadata.file_path").alias("__file"))
    if names.isEmpty():
        return of(files)
    plain = ~F.col("_metadata.file_name").rlike(rf"\.({'|'.join(PACKED)})$")
    ends = read("text").filter((F.col("_metadata.file_size") > WHOLE) & plain)
    lines = ends.select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_size").alias("__size"), F.col("_metadata.file_block_start").alias("__block"), F.col("value").cast("binary").alias("__bytes"))
    pieces = lines.mapInArrow(_pieces, "__file string, __size long, __block long, __at long, __bytes binary")
    hashed = pieces.repartition("__file").sortWithinPartitions("__file", "__block", "__at").mapInArrow(_hashed, "__file string, sha256 string")
    found = hashed.join(F.broadcast(names), "__file").select("path", "sha256", "length")
    return of(files.filter(~large)).union(of(read("binaryFile", f"*.{{{','.join(PACKED)}}}").filter(large))).union(found)


def _pieces(batches):
    """Lines of a range of a file, each with its end, as pieces of at most PIECE bytes in their order."""
    last, at, held = None, 0, bytearray()

    def cut(rest: bool):
        nonlocal at
        stop = len(held) if rest else len(held) - len(held) % PIECE
        parts = [bytes(held[i : min(i + PIECE, stop)]) for i in range(0, stop, PIECE)]
        del held[:stop]
        at += len(parts)
        columns = [[x] * len(parts) for x in last] + [range(at - len(parts), at), parts]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["__file", "__size", "__block", "__at", "__bytes"])

    for batch in batches:
        for *key, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != last:
                if last:
                    yield cut(True)
                last, at = key, 0
            held += line
            held += b"\n"
            if len(held) >= 256 * PIECE:
                yield cut(False)
    if last:
        yield cut(True)


def _hashed(batches):
    """SHA-256 of each file from its sorted pieces.

    Whether the last line has an end, and whether the source left out a byte order mark before the first, is seen from the file's size; so the last
    byte is held back, and a second digest begins with the mark.
    """
    last, n, digest, held = None, 0, (), b""

    def done():
        missing = last[1] - n
        if missing not in (0, 1, 3, 4):
            raise ValueError(f"{last[0]} has {last[1]} bytes, {n} were read")
        made = digest[missing >= 3]
        if missing % 3:
            made.update(held)
        return pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([made.hexdigest()])], names=["__file", "sha256"])

    for batch in batches:
        for file, size, part in zip(*(batch.column(k).to_pylist() for k in (0, 1, 4)), strict=True):
            if (file, size) != last:
                if last:
                    yield done()
                last, n, digest, held = (file, size), -1, (hashlib.sha256(), hashlib.sha256(_MARK)), b""
            for d in digest:
                d.update(held + part[:-1])
            n, held = n + len(part), part[-1:]
    if last:
        yield done()


def without_nan(df: DataFrame) -> DataFrame:
    """Doubles that are NaN or infinite become NULL: what tables are stored with."""
    return df.select(*[F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_stage(df: DataFrame, folder: str, stage: int) -> None:
    """One stage's table, partitioned by stage."""
    without_nan(df).withColumn("stage", F.lit(stage)).write.mode("append").partitionBy("stage").parquet(folder)
