"""Progressive JPEG in numpy: coefficient arrays to scans and back, and coefficients to RGB.

Scans are spectral selections (bands of zigzag positions) sent by successive approximation (first without the low bit, then
that bit). The decoder accumulates every scan of a three- or one-component progressive file into one coefficient array per
component, then dequantises, inverse-transforms all blocks with one matrix product, upsamples chroma and converts to RGB.
Scans whose Huffman table has one code have a fixed stride and are read as arrays; end-of-block runs of refinement
scans are read as arrays too; other scans are read code by code.
"""

from __future__ import annotations

import functools
import re
import struct

import numpy as np

# Fixed values of the format: natural position of each zigzag position.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])


def _idct_matrix() -> np.ndarray:
    """(64, 64): zigzag coefficients times this give the 8 x 8 samples, row by row."""
    u, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    basis = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    return np.kron(basis, basis)[ZIGZAG].astype(np.float32)


IDCT = _idct_matrix()
_MARKER = re.compile(rb"\xff[\x01-\xcf\xd8-\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")
_MSB = 1 << np.arange(15, -1, -1)


class Frame:
    """Size, sampling factors (horizontal, vertical) per component, quantisation rows, coefficients (rows, columns, 64) in zigzag order."""

    def __init__(self, width: int, height: int, sampling: list[tuple[int, int]], quant: list[np.ndarray]) -> None:
        self.width, self.height, self.sampling, self.quant = width, height, sampling, quant
        self.hmax, self.vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
        self.mcus = (-(-height // (8 * self.vmax)), -(-width // (8 * self.hmax)))
        self.coef = [np.zeros((self.mcus[0] * v, self.mcus[1] * h, 64), dtype=np.int16) for h, v in sampling]

    def blocks(self, parts: list[int]) -> list[tuple[int, np.ndarray]]:
        """Block order of a scan, as component and flat block index in turn: MCU by MCU, or one component's real blocks row by row."""
        order = _block_order if self.mcus[0] * self.mcus[1] <= 256 else _block_order.__wrapped__
        return order(self.width, self.height, tuple(self.sampling), tuple(parts))


@functools.lru_cache(maxsize=1024)
def _block_order(width: int, height: int, sampling: tuple, parts: tuple) -> list[tuple[int, np.ndarray]]:
    hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
    mrows, mcols = -(-height // (8 * vmax)), -(-width // (8 * hmax))
    if len(parts) == 1:
        h, v = sampling[parts[0]]
        rows = -(-(-(-height * v // vmax)) // 8)
        cols = -(-(-(-width * h // hmax)) // 8)
        return [(parts[0], (np.arange(rows)[:, None] * (mcols * h) + np.arange(cols)).ravel()[:, None])]
    out = []
    for c in parts:
        h, v = sampling[c]
        r, k, y, x = np.ix_(np.arange(mrows), np.arange(mcols), np.arange(v), np.arange(h))
        out.append((c, ((r * v + y) * (mcols * h) + k * h + x).reshape(-1, h * v)))
    return out


def _category(a: np.ndarray) -> np.ndarray:
    """Bits of the magnitude."""
    return np.frexp(a.astype(np.float32))[1].astype(np.int64)


def _pack(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Concatenate values of up to 30 bits, pad with ones, stuff zero bytes after 0xFF."""
    n = int(lengths.sum())
    which = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    bits = (values[which] >> (lengths[which] - 1 - at)) & 1
    return _stuff(bits.astype(np.uint8))


def _stuff(bits: np.ndarray) -> bytes:
    data = np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, dtype=np.uint8)]))
    full = np.flatnonzero(data == 255)
    return (np.insert(data, full + 1, 0) if len(full) else data).tobytes()


@functools.lru_cache(maxsize=256)
def _table(symbols: tuple[int, ...]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """DHT payload and symbol -> (code, length): one code of one bit, or equal lengths with the all-ones code unused."""
    n = len(symbols)
    length = max(1, n.bit_length())
    if length > 8:
        counts = [0] * 7 + [510 - n, 2 * n - 510] + [0] * 7 if n > 255 else [0] * 7 + [n] + [0] * 8
    else:
        counts = [n if k + 1 == length else 0 for k in range(16)]
    codes, code, k = {}, 0, 0
    for bits, count in enumerate(counts, 1):
        for _ in range(count):
            codes[symbols[k]] = (code, bits)
            code, k = code + 1, k + 1
        code <<= 1
    return bytes(counts) + bytes(symbols), codes


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _scan(parts: list[int], lo: int, hi: int, ah: int, al: int, dc: bool, table: bytes | None, data: bytes) -> bytes:
    head = bytes([len(parts)]) + b"".join(bytes([c + 1, 0]) for c in parts) + bytes([lo, hi, ah << 4 | al])
    return (_segment(0xC4, bytes([0 if dc else 0x10]) + table) if table else b"") + _segment(0xDA, head) + data


def _dc_first(frame: Frame, parts: list[int], al: int) -> bytes:
    order = frame.blocks(parts)
    diffs = []
    for c, index in order:
        v = frame.coef[c].reshape(-1, 64)[:, 0].astype(np.int64)[index] >> al
        diffs.append(np.diff(v.ravel(), prepend=0).reshape(v.shape))
    d = np.concatenate(diffs, axis=1).ravel()
    cat = _category(np.abs(d))
    table, codes = _table(tuple(sorted(set(cat.tolist()))))
    code = np.zeros(17, dtype=np.int64)
    bits = np.zeros(17, dtype=np.int64)
    for s, (a, b) in codes.items():
        code[s], bits[s] = a, b
    extra = np.where(d < 0, d + (1 << cat) - 1, d)
    return _scan(parts, 0, 0, 0, al, True, table, _pack(code[cat] << cat | extra, bits[cat] + cat))


def _dc_refine(frame: Frame, parts: list[int], al: int) -> bytes:
    bits = np.concatenate([(frame.coef[c].reshape(-1, 64)[index, 0] >> al) & 1 for c, index in frame.blocks(parts)], axis=1)
    return _scan(parts, 0, 0, al + 1, al, True, None, _stuff(bits.ravel().astype(np.uint8)))


def _ac_first(frame: Frame, c: int, lo: int, hi: int, al: int) -> bytes:
    index = frame.blocks([c])[0][1].ravel()
    v = frame.coef[c].reshape(-1, 64)[index, lo : hi + 1].astype(np.int32)
    a = np.abs(v) >> al
    s = int(a.max()).bit_length()
    if s and int(a.min()).bit_length() == s:
        extra = np.where(v < 0, (1 << s) - 1 - a, a)
        table, _ = _table((s,))
        return _scan([c], lo, hi, 0, al, False, table, extra.astype(np.uint8).tobytes() if s == 7 else _pack(extra.ravel(), np.full(a.size, s + 1)))
    cat = _category(a)
    extra = np.where(v < 0, (1 << cat) - 1 - a, a)
    sent = []  # symbol, extra, bits
    for row, cats, more in zip(a.tolist(), cat.tolist(), extra.tolist(), strict=True):
        run = 0
        for x, s, e in zip(row, cats, more, strict=True):
            if not x:
                run += 1
                continue
            while run > 15:
                sent.append((0xF0, 0, 0))
                run -= 16
            sent.append((run << 4 | s, e, s))
            run = 0
        if run:
            sent.append((0, 0, 0))
    return _coded([c], lo, hi, 0, al, sent)


def _coded(parts: list[int], lo: int, hi: int, ah: int, al: int, sent: list[tuple]) -> bytes:
    """sent: (symbol, extra, bits, correction bits...)."""
    table, codes = _table(tuple(sorted({x[0] for x in sent})))
    values, lengths = [], []
    for s, e, n, *rest in sent:
        values += [codes[s][0] << n | e, *rest]
        lengths += [codes[s][1] + n, *([1] * len(rest))]
    return _scan(parts, lo, hi, ah, al, False, table, _pack(np.array(values, dtype=np.int64), np.array(lengths, dtype=np.int64)))


def _ac_refine(frame: Frame, c: int, lo: int, hi: int, al: int) -> bytes:
    index = frame.blocks([c])[0][1].ravel()
    v = frame.coef[c].reshape(-1, 64)[index, lo : hi + 1]
    a = np.abs(v) >> al
    if (a > 1).all() and len(a) < 32768:  # nothing new: one end-of-block run, then a bit for each coefficient
        n = len(a).bit_length() - 1
        table, _ = _table((n << 4,))
        head = np.array([0, *((len(a) >> k & 1) for k in range(n - 1, -1, -1))], dtype=np.uint8)
        return _scan([c], lo, hi, al + 1, al, False, table, _stuff(np.concatenate([head, (a & 1).ravel().astype(np.uint8)])))
    sent = []
    for row, signs in zip(a.tolist(), (v < 0).tolist(), strict=True):
        last = max((k for k, x in enumerate(row) if x == 1), default=-1)
        run, bits = 0, []
        for k, x in enumerate(row):
            if x > 1:
                bits.append(x & 1)
            elif x == 1:
                sent.append((run << 4 | 1, int(not signs[k]), 1, *bits))
                run, bits = 0, []
            else:
                run += 1
                if run == 16 and k < last:
                    sent.append((0xF0, 0, 0, *bits))
                    run, bits = 0, []
        if run or bits:
            sent.append((0, 0, 0, *bits))
    return _coded([c], lo, hi, al + 1, al, sent)


def encode(frame: Frame, comment: bytes = b"", al: int = 1) -> bytes:
    """All scans of a frame: DC, luma's low band, chroma, luma's high band without `al` low bits, then those bits."""
    n = len(frame.coef)
    out = [b"\xff\xd8", _segment(0xFE, comment) if comment else b""]
    out += [_segment(0xDB, bytes([k]) + bytes(q.astype(np.uint8).tolist())) for k, q in enumerate(frame.quant)]
    parts = b"".join(bytes([c + 1, h << 4 | v, min(c, len(frame.quant) - 1)]) for c, (h, v) in enumerate(frame.sampling))
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, frame.height, frame.width, n) + parts))
    every = list(range(n))
    out.append(_dc_first(frame, every, al))
    out += [_ac_first(frame, c, lo, hi, al) for c, lo, hi in ((0, 1, 5), *((c, 1, 63) for c in every[1:]), (0, 6, 63))]
    for k in range(al - 1, -1, -1):
        out.append(_dc_refine(frame, every, k))
        out += [_ac_refine(frame, c, 1, 63, k) for c in every]
    return b"".join([*out, b"\xff\xd9"])


# --- reading ----------------------------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=256)
def _codes(counts: bytes, symbols: bytes) -> _Codes:
    return _Codes(counts, symbols)


class _Codes:
    """A Huffman table: (length, symbol) by the next 16 bits; only: the one code's (length, symbol), if it has one."""

    def __init__(self, counts: bytes, symbols: bytes) -> None:
        self.only = (next(k for k, n in enumerate(counts, 1) if n), symbols[0]) if len(symbols) == 1 else None
        self.counts, self.symbols, self._look = counts, symbols, None

    @property
    def look(self) -> list[tuple[int, int]]:
        if self._look is None:
            out: list[tuple[int, int]] = []
            k = 0
            for bits, n in enumerate(self.counts, 1):
                for s in self.symbols[k : k + n]:
                    out += [(bits, s)] * (1 << (16 - bits))
                k += n
            self._look = out + [(17, 0)] * (65536 - len(out))
        return self._look


class _Bits:
    """Bits of unstuffed bytes: arrays of single bits, or up to 16 bits at a position."""

    def __init__(self, data: np.ndarray) -> None:
        self.data, self.at = data, 0
        self._words = None

    def peek(self) -> int:
        if self._words is None:
            d = np.concatenate([self.data, np.full(3, 255, dtype=np.uint8)]).astype(np.int64)
            self._words = (d[:-2] << 16 | d[1:-1] << 8 | d[2:]).tolist()
        return (self._words[self.at >> 3] >> (8 - (self.at & 7))) & 0xFFFF

    def take(self, n: int) -> int:
        if not n:
            return 0
        v = self.peek() >> (16 - n)
        self.at += n
        return v

    def symbol(self, codes: _Codes) -> int:
        n, s = codes.look[self.peek()]
        if n > 16:
            raise ValueError("no such Huffman code")
        self.at += n
        return s

    def array(self, n: int) -> np.ndarray:
        first = self.at >> 3
        got = np.unpackbits(self.data[first : (self.at + n + 7) >> 3])[self.at & 7 :][:n]
        if len(got) < n:
            raise ValueError("the scan ends early")
        self.at += n
        return got


def _signed(v, s):
    return v - ((v < (1 << s >> 1)) * ((1 << s) - 1))


def _read_dc_first(bits: _Bits, frame: Frame, order: list, codes: list[_Codes], al: int, part: slice) -> None:
    where = [(c, index[part]) for c, index in order]
    per = [index.shape[1] for _, index in where]
    n = where[0][1].shape[0]
    last, got = [0] * len(where), [[] for _ in where]
    words = bits.peek() is not None and bits._words
    at = bits.at
    looks = [codes[c].look for c, _ in where]
    for _ in range(n):
        for k, m in enumerate(per):
            look, keep = looks[k], got[k]
            for _ in range(m):
                size, s = look[(words[at >> 3] >> (8 - (at & 7))) & 0xFFFF]
                at += size
                if s:
                    v = ((words[at >> 3] >> (8 - (at & 7))) & 0xFFFF) >> (16 - s)
                    at += s
                    last[k] += v if v >> (s - 1) else v - (1 << s) + 1
                keep.append(last[k])
    bits.at = at
    for (c, index), v in zip(where, got, strict=True):
        frame.coef[c].reshape(-1, 64)[index.ravel(), 0] = np.array(v, dtype=np.int64) << al


def _read_dc_refine(bits: _Bits, frame: Frame, order: list, al: int, part: slice) -> None:
    where = [(c, index[part]) for c, index in order]
    per = [index.shape[1] for _, index in where]
    got = bits.array(where[0][1].shape[0] * sum(per)).reshape(-1, sum(per)).astype(np.int16)
    at = 0
    for (c, index), m in zip(where, per, strict=True):
        frame.coef[c].reshape(-1, 64)[index.ravel(), 0] |= got[:, at : at + m].ravel() << al
        at += m


def _read_ac_first(bits: _Bits, flat: np.ndarray, index: np.ndarray, codes: _Codes, lo: int, hi: int, al: int) -> None:
    if codes.only and codes.only[1] >> 4 == 0 and codes.only[1] & 15:
        size, s = codes.only
        n = len(index) * (hi - lo + 1)
        if size + s == 8 and bits.at == 0:
            v = bits.data[:n].astype(np.int16) & ((1 << s) - 1)
        else:
            v = bits.array(n * (size + s)).reshape(n, size + s)[:, size:].astype(np.int32) @ _MSB[16 - s :].astype(np.int32)
        flat[index, lo : hi + 1] = (_signed(v, s) * (1 << al)).reshape(len(index), -1)
        return
    run = 0
    for b in index.tolist():
        if run:
            run -= 1
            continue
        k = lo
        while k <= hi:
            rs = bits.symbol(codes)
            r, s = rs >> 4, rs & 15
            if s:
                k += r
                flat[b, k] = _signed(bits.take(s), s) * (1 << al)
            elif r == 15:
                k += 15
            else:
                run = (1 << r) + bits.take(r) - 1
                break
            k += 1


def _read_ac_refine(bits: _Bits, flat: np.ndarray, index: np.ndarray, codes: _Codes, lo: int, hi: int, al: int) -> None:
    one = 1 << al

    def correct(rows: np.ndarray, first: int) -> None:
        """A bit for each coefficient of the rows that is not zero so far, from the position on."""
        band = flat[rows, first : hi + 1]
        known = band != 0
        n = int(np.count_nonzero(known))
        step = bits.array(n).astype(np.int16) * one
        if n == band.size:
            step = step.reshape(band.shape)
        else:
            step, some = np.zeros(band.shape, dtype=np.int16), step
            step[known] = some
        flat[rows, first : hi + 1] = band + np.where(band < 0, -step, step)

    b = 0
    while b < len(index):
        row, k, run = index[b], lo, 0
        while k <= hi:
            rs = bits.symbol(codes)
            r, s = rs >> 4, rs & 15
            if s == 0 and r < 15:
                run = (1 << r) + bits.take(r)
                break
            new = (one if bits.take(1) else -one) if s else 0
            while k <= hi:
                v = int(flat[row, k])
                if v:
                    if bits.take(1):
                        flat[row, k] = v + (one if v > 0 else -one)
                elif r == 0:
                    if new:
                        flat[row, k] = new
                    k += 1
                    break
                else:
                    r -= 1
                k += 1
        if run:
            correct(index[b : b + 1], k)
            if run > 1:
                correct(index[b + 1 : b + run], lo)
            b += run
        else:
            b += 1


def decode(data: bytes) -> tuple[Frame, bytes]:
    """All scans of a progressive JPEG, accumulated; and its comment."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, comment, restart = 2, b"", 0
    quant: dict[int, np.ndarray] = {}
    tables: dict[int, _Codes] = {}
    frame: Frame | None = None
    ids: list[int] = []
    while at + 4 <= len(data):
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            comment = body
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], dtype=">u2" if wide else "u1").astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            _, h, w, n = struct.unpack_from(">BHHB", body)
            spec = [body[6 + 3 * k : 9 + 3 * k] for k in range(n)]
            ids = [s[0] for s in spec]
            frame = Frame(w, h, [(s[1] >> 4, s[1] & 15) for s in spec], [quant[s[2]] for s in spec])
        elif marker in (0xC0, 0xC1, 0xC3) or 0xC5 <= marker <= 0xCF:
            raise ValueError("only progressive Huffman-coded files are read")
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("a scan before the frame")
            n = body[0]
            parts = [ids.index(body[1 + 2 * k]) for k in range(n)]
            chosen = [body[2 + 2 * k] for k in range(n)]
            lo, hi, approx = body[1 + 2 * n : 4 + 2 * n]
            end = _MARKER.search(data, at)
            if not end:
                raise ValueError("the file ends in a scan")
            pieces = _RESTART.split(data[at : end.start()]) if restart else [data[at : end.start()]]
            at = end.start()
            order, ah, al = frame.blocks(parts), approx >> 4, approx & 15
            for k, piece in enumerate(pieces):
                raw = np.frombuffer(piece, dtype=np.uint8)
                full = np.flatnonzero(raw[:-1] == 255)
                bits = _Bits(np.delete(raw, full + 1) if len(full) else raw)
                part = slice(k * restart, (k + 1) * restart) if restart else slice(None)
                if lo == 0 and ah == 0:
                    _read_dc_first(bits, frame, order, {c: tables[t >> 4] for c, t in zip(parts, chosen, strict=True)}, al, part)
                elif lo == 0:
                    _read_dc_refine(bits, frame, order, al, part)
                else:
                    c, index = order[0]
                    read = _read_ac_refine if ah else _read_ac_first
                    read(bits, frame.coef[c].reshape(-1, 64), index.ravel()[part], tables[0x10 | chosen[0] & 15], lo, hi, al)
    if frame is None:
        raise ValueError("no frame")
    return frame, comment


def to_rgb(frame: Frame) -> np.ndarray:
    """(height, width, 3) samples of 8 bits: inverse transform, chroma repeated to full size, YCbCr to RGB."""
    planes = []
    for c, coef in enumerate(frame.coef):
        rows, cols = coef.shape[:2]
        x = (coef.reshape(-1, 64).astype(np.float32) * frame.quant[c]) @ IDCT
        plane = x.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8) + np.float32(128)
        np.clip(plane, 0, 255, out=plane)
        h, v = frame.sampling[c]
        if v != frame.vmax:
            plane = plane.repeat(frame.vmax // v, axis=0)
        if h != frame.hmax:
            plane = plane.repeat(frame.hmax // h, axis=1)
        planes.append(plane[: frame.height, : frame.width])
    if len(planes) == 1:
        return np.rint(planes[0]).astype(np.uint8)[:, :, None].repeat(3, axis=2)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.empty((*y.shape, 3), dtype=np.uint8)
    for k, plane in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
        np.clip(plane, 0, 255, out=plane)
        out[:, :, k] = np.rint(plane, out=plane)
    return out
