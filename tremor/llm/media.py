"""Media columns: bytes kept losslessly in progressive JPEGs, and their RGB tensors and features.

A payload (a text's UTF-8 bytes, filled with zeros to a multiple of 64) is stored in the format's own unit: each 8 x 8 block's
64 quantised coefficients hold 64 bytes. Byte b is coefficient b from 128 on and b - 255 below, so every coefficient has
eight magnitude bits, never vanishes, and survives the file exactly (pixels would not). Blocks fill Y, then Cb, then Cr of a
4:2:0 frame. Reading accumulates the scans, takes the payload from the coefficients, and gives the RGB tensor.

Defined cases: null text counts as empty; an empty text is 64 zero bytes; equal texts give equal files; further columns are
ignored; one text of any length up to about 6 GB is one file.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tremor.llm import jpeg
from tremor.llm.common import map_texts

_QUANT = [np.ones(64), np.ones(64)]
SAMPLING = [(2, 2), (1, 1), (1, 1)]


def pad64(raw: bytes) -> bytes:
    """Zeros up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % 64 if raw else 64)


def store(payload: bytes) -> bytes:
    """A progressive JPEG that holds the payload (a positive multiple of 64 bytes)."""
    units = -(-len(payload) // 384)
    wide = int(np.ceil(np.sqrt(units)))
    high = -(-units // wide)
    frame = jpeg.Frame(16 * wide, 16 * high, SAMPLING, _QUANT)
    b = np.zeros(wide * high * 384, dtype=np.int16)
    b[: len(payload)] = np.frombuffer(payload, dtype=np.uint8)
    v = np.where(b < 128, b - 255, b).astype(np.int16).reshape(-1, 64)
    cut = wide * high
    for k, part in enumerate((v[: 4 * cut], v[4 * cut : 5 * cut], v[5 * cut :])):
        frame.coef[k][:] = part.reshape(frame.coef[k].shape)
    return jpeg.encode(frame, comment=b"payload=%d" % len(payload))


def load(media: bytes) -> tuple[bytes, jpeg.Frame]:
    """The payload, read from the file's scans, and the frame."""
    frame, comment = jpeg.decode(media)
    v = np.concatenate([c.ravel() for c in frame.coef])
    b = np.where(v < 0, v + 255, v).astype(np.uint8)
    return b[: int(comment.removeprefix(b"payload="))].tobytes(), frame


def features_of(rgb: np.ndarray) -> str:
    """Size, and mean and deviation of each channel, from exact integer sums."""
    flat = rgb.reshape(-1, 3)
    n = len(flat)
    counts = [np.bincount(flat[:, k], minlength=256) for k in range(3)]
    level = np.arange(256)
    means = [int(c @ level) / n for c in counts]
    devs = [max(0.0, int(c @ (level * level)) / n - m * m) ** 0.5 for c, m in zip(counts, means, strict=True)]
    return f"{rgb.shape[0]}x{rgb.shape[1]};mean=" + ",".join(f"{m:.3f}" for m in means) + ";std=" + ",".join(f"{d:.3f}" for d in devs)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_files: bool = True) -> DataFrame:
    """One row per document: sizes, digests and features of its file; with keep_files also the file and the RGB tensor."""
    fields = [
        T.StructField(id_col, docs.schema[id_col].dataType),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
    ]
    if keep_files:
        fields += [T.StructField("media", T.BinaryType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("rgb", T.BinaryType())]

    def run(ids, texts):
        rows: list[tuple] = []
        seen: dict[str, tuple] = {}  # equal texts of one step are stored once
        for i, t in zip(ids, texts, strict=True):
            if (known := seen.get(t or "")) is not None:
                rows.append((i, *known))
                continue
            raw = (t or "").encode("utf-8", "surrogatepass")
            media = store(pad64(raw))
            payload, frame = load(media)
            rgb = jpeg.to_rgb(frame)
            row = (i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features_of(rgb))
            rows.append((*row, media, rgb.shape[0], rgb.shape[1], rgb.tobytes()) if keep_files else row)
            seen[t or ""] = rows[-1][1:]
        return {f.name: [r[k] for r in rows] for k, f in enumerate(fields)}

    return map_texts(docs.select(id_col, text_col), run, T.StructType(fields))


def decode_images(images: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """RGB tensors of a column of progressive JPEGs; a null or unreadable file gives nulls and its error."""
    schema = T.StructType([T.StructField(id_col, images.schema[id_col].dataType), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("rgb", T.BinaryType()), T.StructField("error", T.StringType())])

    def run(ids, files):
        rows = []
        for x in files:
            try:
                rgb = jpeg.to_rgb(jpeg.decode(x)[0]) if x is not None else None
                rows.append((None, None, None, None) if rgb is None else (rgb.shape[0], rgb.shape[1], rgb.tobytes(), None))
            except (ValueError, IndexError, KeyError) as e:
                rows.append((None, None, None, str(e) or type(e).__name__))
        return {id_col: ids, "height": [r[0] for r in rows], "width": [r[1] for r in rows], "rgb": [r[2] for r in rows], "error": [r[3] for r in rows]}

    return map_texts(images.select(id_col, media_col), run, schema)


def media_digest(docs: DataFrame) -> DataFrame:
    return media_columns(docs, keep_files=False)
