"""SentencePiece encoding and decoding with sampled segmentations.

Text becomes a lattice of vocabulary pieces (a space is the mark U+2581, one mark goes in front). Segmentations are sampled by forward
filtering and backward sampling: forward sums weigh every prefix, then pieces are drawn from the end back, each in proportion to
its weight times the forward sum before it. Draws come from a counter-based generator over (row key, position), so a row's
segmentation is the same however the table is partitioned. Decoding is lossless for every text: characters the vocabulary lacks,
and a mark that stood in the text itself, go through byte pieces.

The lattice falls apart where no longer piece can cross (before marks, around characters that only stand alone), so equal parts share one
lattice per step: it is built and filtered in numpy for all distinct parts at once, and all their occurrences are drawn
together. No row is shuffled. The vocabulary file is read by the driver, and its pieces, a table of fixed size, go to the tasks.

A unigram model's scores are log-probabilities. A BPE model has merge ranks instead; a piece of rank r then weighs 1 / (r + 1), as frequency
falls with rank. Weights are raised to `alpha` (0: all segmentations alike, large: the best one).

Defined cases: null text has null ids; an empty text has none; row keys that repeat with equal texts give equal results; very long texts
are encoded whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tremor.llm.common import POWERS, map_texts, mix64

#: Where the public vocabulary lies; a parameter of every function that needs it.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
OWN_MARK = 0x110000  # a mark that stood in the text
CHUNK = 1_000_000
#: Characters of a part from which on it is filtered and drawn by itself, node by node, not beside all others.
LONG = 2000


class HashIndex:
    """Value of each 64-bit key, found in a few array steps; -1 where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = 17) -> None:
        self.levels = []
        left = np.arange(len(keys))
        shift = 64 - bits
        while len(left):
            slots = (keys[left] >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1)
            _, first = np.unique(slots, return_index=True)
            key, value, more = np.zeros(1 << bits, dtype=np.uint64), np.full(1 << bits, -1, dtype=np.int32), np.zeros(1 << bits, dtype=bool)
            key[slots[first]], value[slots[first]] = keys[left[first]], values[left[first]]
            rest = np.ones(len(left), dtype=bool)
            rest[first] = False
            more[slots[rest]] = True
            self.levels.append((shift, key, value, more))
            left, shift = left[rest], (shift - 7) % (64 - bits)
        self.mask = (1 << bits) - 1

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int32)
        todo = None
        for shift, key, value, more in self.levels:
            k = keys if todo is None else keys[todo]
            slot = (k >> np.uint64(shift)).astype(np.int64) & self.mask
            got = np.where(key[slot] == k, value[slot], -1)
            missing = (got < 0) & more[slot]
            if todo is None:
                out = got
                todo = np.flatnonzero(missing)
            else:
                out[todo] = got
                todo = todo[missing]
            if not len(todo):
                break
        return out


class Vocabulary:
    """Pieces by id, their weights, and an index of pieces and of their beginnings."""

    def __init__(self, pieces: list[str], weights: list[float], kinds: list[str]) -> None:
        """kinds: piece, byte or none (control pieces, which are never produced)."""
        self.pieces, self.kinds = pieces, kinds
        self.byte_id = np.zeros(256, dtype=np.int32)
        for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
            if k == "byte":
                self.byte_id[int(p[3:5], 16)] = i
        self.text = [
            bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(chr(MARK), " ").encode("utf-8", "surrogatepass") if k == "piece" else b"" for p, k in zip(pieces, kinds, strict=True)
        ]
        known = [(p, i) for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "piece" and p]
        self.longest = max((len(p) for p, _ in known), default=1)
        self.weight = np.array([*weights, 1e-12], dtype=np.float64)  # the last: a character in bytes
        entries: dict[str, int] = {}
        for p, _ in known:
            for n in range(1, len(p)):
                entries.setdefault(p[:n], 1 << 30)  # a beginning only
        entries.update(known)
        self.solo_free = np.zeros(OWN_MARK + 1, dtype=bool)  # code points inside longer pieces
        self.solo_free[[ord(c) for p, _ in known if len(p) > 1 for c in p]] = True
        self.index = HashIndex(np.array([self._key(p) for p in entries], dtype=np.uint64), np.array(list(entries.values()), dtype=np.int32))

    @staticmethod
    def _key(p: str) -> int:
        h = np.zeros(1, dtype=np.uint64)
        for c in p:
            h = extend(h, np.array([ord(c)], dtype=np.uint64))
        return int(h[0])


def extend(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Hash of a string and one more character."""
    h = (h ^ (c + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def load_vocabulary(model: str = MODEL) -> Vocabulary:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    n = m.get_piece_size()
    scores = np.array([m.get_score(i) for i in range(n)])
    kinds = ["byte" if m.is_byte(i) else "none" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "piece" for i in range(n)]
    own = scores[[k == "piece" for k in kinds]]
    ranks = len(own) and np.array_equal(own, np.round(own)) and own.min() < -1000
    weights = 1.0 / (1.0 + np.maximum(0.0, -scores)) if ranks else np.exp(np.maximum(scores, -50.0))
    return Vocabulary([m.id_to_piece(i) for i in range(n)], weights.tolist(), kinds)


def _uniform(seed: np.ndarray, position: np.ndarray) -> np.ndarray:
    x = mix64(seed ^ mix64(position.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _shares(head: np.ndarray, tail: np.ndarray, end: np.ndarray, logw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each edge's share of the forward sum at its end node, all parts side by side; end: the end nodes' places in their parts, ascending."""
    forward = np.full(at[-1], -np.inf)
    forward[at[:-1]] = 0.0
    steps = np.concatenate(([0], np.cumsum(np.bincount(end)))) if len(end) else [0]
    share = np.empty(len(head))
    for k in range(1, len(steps) - 1):
        lo, hi = steps[k], steps[k + 1]
        if lo == hi:
            continue
        t = tail[lo:hi]
        v = forward[head[lo:hi]] + logw[lo:hi]
        new = np.flatnonzero(np.diff(t, prepend=-1))
        top = np.maximum.reduceat(v, new)
        group = np.cumsum(np.diff(t, prepend=t[0]) != 0)
        e = np.exp(v - top[group])
        total = np.add.reduceat(e, new)
        forward[t[new]] = top + np.log(total)
        share[lo:hi] = e / total[group]
    return share


def _long_shares(head: list[int], end: np.ndarray, w: list[float], longest: int) -> list[float]:
    """The same for one part. Sums are kept as plain numbers and scaled together whenever they get small or large."""
    n = int(end[-1])
    bounds = np.searchsorted(end, np.arange(n + 2)).tolist()
    forward = [0.0] * (n + 1)
    forward[0] = 1.0
    share = [1.0] * len(head)
    for t in range(1, n + 1):
        lo, hi = bounds[t], bounds[t + 1]
        if hi - lo == 1:
            total = forward[head[lo]] * w[lo]
        else:
            v = [forward[h] * x for h, x in zip(head[lo:hi], w[lo:hi], strict=True)]
            total = sum(v)
            share[lo:hi] = [x / total for x in v]
        if not 1e-100 < total < 1e100:
            scale = 1e100 if total < 1 else 1e-100
            for j in range(max(0, t - longest), t):
                forward[j] *= scale
            total *= scale
        forward[t] = total
    return share


def _draw_long(out: np.ndarray, u: np.ndarray, head: list[int], end: np.ndarray, upto: list[float], piece: list[int]) -> None:
    """Draws one part from its end back; out and u: a place for each character, where a piece that ends with it is put, and its number."""
    first = np.searchsorted(end, np.arange(len(u) + 1)).tolist()
    numbers = u.tolist()
    at, places, pieces = len(u), [], []
    while at:
        edge, x = first[at], numbers[at - 1]
        while upto[edge] <= x:
            edge += 1
        places.append(at - 1)
        pieces.append(piece[edge])
        at = head[edge]
    out[places] = pieces


def encode_batch(texts: list[str], seeds: np.ndarray, vocabulary: Vocabulary, alpha: float) -> list[np.ndarray]:
    """Sampled ids of each text (none of them empty); seeds: 64 bits for each."""
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    marked = "\0" + "\0".join(texts)  # a place in front of each text for its first mark
    c = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    c = np.where(c == MARK, OWN_MARK, np.where(c == 32, MARK, c))
    c[begin[:-1]] = MARK
    n = len(c)
    free = vocabulary.solo_free[c]
    cut = ~free
    cut[1:] |= ~free[:-1] | ((c[1:] == MARK) & (c[:-1] != MARK))
    cut[begin[:-1]] = True
    start = np.flatnonzero(cut)
    stop = np.append(start[1:], n)

    # distinct parts, by a hash of their code points
    sums = np.zeros(n + 1, dtype=np.uint64)
    up, down = POWERS.get(n + 1)
    np.cumsum(mix64(c.astype(np.uint64) + np.uint64(77)) * up[:n], out=sums[1:])
    keys = mix64((sums[stop] - sums[start]) * down[start] ^ (stop - start).astype(np.uint64))
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    length = (stop - start)[first]
    at = np.concatenate(([0], np.cumsum(length + 1)))  # nodes of part k: at[k] to at[k] + length
    offset = np.arange(at[-1]) - np.repeat(at[:-1], length + 1)
    room = np.repeat(length, length + 1) - offset  # characters from a node to the end of its part
    chars = np.zeros(at[-1], dtype=np.uint64)
    inner = room > 0
    source = np.repeat(start[first] - at[:-1], length + 1) + np.arange(at[-1])
    chars[inner] = c[source[inner]].astype(np.uint64)

    # edges: pieces that start at each node
    node = np.flatnonzero(inner)
    h = np.zeros(len(node), dtype=np.uint64)
    heads, tails, ids = [], [], []
    covered = np.zeros(at[-1], dtype=bool)
    for k in range(vocabulary.longest):
        h = extend(h, chars[node + k])
        found = vocabulary.index.get(h)
        piece = (found >= 0) & (found < 1 << 30)
        heads.append(node[piece])
        tails.append(node[piece] + k + 1)
        ids.append(found[piece])
        if k == 0:
            covered[node[piece]] = True
        on = (found >= 0) & (room[node] > k + 1)
        node, h = node[on], h[on]
        if not len(node):
            break
    alone = np.flatnonzero(inner & ~covered)  # characters without a piece of their own: bytes
    fallback = len(vocabulary.pieces)
    head = np.concatenate([*heads, alone])
    tail = np.concatenate([*tails, alone + 1])
    piece = np.concatenate([*ids, np.full(len(alone), fallback, dtype=np.int32)])

    # forward sums, by the place of an edge's end in its part; scaled at each node so that long parts neither vanish nor overflow
    order = np.lexsort((tail, offset[tail]))
    head, tail, piece = head[order], tail[order], piece[order]
    w = vocabulary.weight[piece] ** alpha
    share = np.empty(len(head))
    part = np.searchsorted(at, tail, side="right") - 1
    by_part = {k: np.flatnonzero(part == k) for k in np.flatnonzero(length > LONG).tolist()}
    for k, at_edge in by_part.items():
        share[at_edge] = _long_shares((head[at_edge] - at[k]).tolist(), offset[tail[at_edge]], w[at_edge].tolist(), vocabulary.longest)
    short = np.flatnonzero(length[part] <= LONG)
    share[short] = _shares(head[short], tail[short], offset[tail[short]], np.log(w[short]), at)

    # cumulative shares within each end node, and where its edges begin
    ends = np.flatnonzero(np.diff(tail, prepend=-1))
    entry = np.zeros(at[-1], dtype=np.int32)
    entry[tail[ends]] = ends
    count = np.diff(np.append(ends, len(tail)))
    upto = share.copy()  # summed node by node, so that a draw doesn't depend on what else is in the chunk
    for k in range(1, int(count.max(initial=0))):
        on = ends[count > k] + k
        upto[on] += upto[on - 1]
    upto[np.append(ends[1:], len(tail)) - 1] = 2.0
    head, offset = head.astype(np.int32), offset.astype(np.int32)

    # backward draws for all occurrences at once
    out = np.full(n, -1, dtype=np.int32)
    now = (at[which] + length[which]).astype(np.int32)
    place = stop.copy()  # end of what is still to draw, in the joined text
    doc = np.repeat(np.arange(len(texts)), sizes)[start]
    seed, origin = seeds[doc], begin[doc]
    for i in np.flatnonzero(length[which] > LONG).tolist():
        k = int(which[i])
        at_edge = by_part[k]
        u = _uniform(np.full(length[k], seed[i]), np.arange(start[i] - origin[i] + 1, stop[i] - origin[i] + 1))
        _draw_long(out[start[i] : stop[i]], u, (head[at_edge] - at[k]).tolist(), offset[tail[at_edge]], upto[at_edge].tolist(), piece[at_edge].tolist())
    on = length[which] <= LONG
    now, place, seed, origin = now[on], place[on], seed[on], origin[on]
    while len(now):
        u = _uniform(seed, place - origin)
        edge = entry[now]
        behind = np.flatnonzero(upto[edge] <= u)
        while len(behind):
            edge[behind] += 1
            behind = behind[upto[edge[behind]] <= u[behind]]
        out[place - 1] = piece[edge]
        before = head[edge]
        place = place - (now - before)
        on = offset[before] > 0
        now, place, seed, origin = before[on], place[on], seed[on], origin[on]

    # ids in order, with characters in bytes spelled out
    spot = np.flatnonzero(out >= 0)
    ids = out[spot]
    ends = np.searchsorted(spot, begin)
    byte = np.flatnonzero(ids == fallback)
    if len(byte):
        cp = c[spot[byte]]
        spelled = [chr(MARK if x == OWN_MARK else x).encode("utf-8", "surrogatepass") for x in cp.tolist()]
        many = np.ones(len(ids), dtype=np.int64)
        many[byte] = [len(s) for s in spelled]
        shift = np.concatenate(([0], np.cumsum(many)))
        ids = np.repeat(ids, many)
        ids[ids == fallback] = vocabulary.byte_id[np.frombuffer(b"".join(spelled), dtype=np.uint8)]
        ends = shift[ends]
    return [ids[lo:hi] for lo, hi in zip(ends, ends[1:], strict=False)]


def decode_ids(ids, vocabulary: Vocabulary) -> str:
    """The text of a sequence of ids."""
    text = vocabulary.text
    whole = b"".join([text[i] for i in ids]).decode("utf-8", "surrogatepass")
    return whole[1:] if whole.startswith(" ") else whole


def row_seeds(keys: list, seed: int) -> np.ndarray:
    """64 bits for each row key (integers, or anything else by its text)."""
    plain = [k & (2**64 - 1) if isinstance(k, int) else zlib.crc32(repr(k).encode()) | 1 << 63 for k in keys]
    return mix64(np.array(plain, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def encode_texts(keys: list, texts: list[str | None], vocabulary: Vocabulary, alpha: float, seed: int) -> list[np.ndarray | None]:
    seeds = row_seeds(keys, seed)
    full = [k for k, t in enumerate(texts) if t]
    out: list = [None if t is None else np.empty(0, dtype=np.int32) for t in texts]
    lo = 0
    while lo < len(full):
        hi, size = lo, 0
        while hi < len(full) and (hi == lo or size + len(texts[full[hi]]) <= CHUNK):
            size += len(texts[full[hi]])
            hi += 1
        part = full[lo:hi]
        for k, ids in zip(part, encode_batch([texts[k] for k in part], seeds[part], vocabulary, alpha), strict=True):
            out[k] = ids
        lo = hi
    return out


def encode_pieces(docs: DataFrame, model: str = MODEL, alpha: float = 0.8, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", check: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, ids (sampled segmentation), n_pieces, with check whether decoding gives the text back, and the columns to carry."""
    vocabulary = load_vocabulary(model)
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_pieces", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    fields += [T.StructField("lossless", T.BooleanType())] if check else []
    fields += [docs.schema[c] for c in carry]

    def run(keys, texts, *carried):
        ids = encode_texts(keys, texts, vocabulary, alpha, seed)
        out = {id_col: keys, "n_pieces": [0 if x is None else len(x) for x in ids], "ids": ids, **dict(zip(carry, carried, strict=True))}
        if check:
            out["lossless"] = [t is None or decode_ids(x.tolist(), vocabulary) == t for x, t in zip(ids, texts, strict=True)]
        return out

    return map_texts(docs.select(id_col, text_col, *carry), run, T.StructType(fields))


def decode_pieces(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per sequence: id and text; null ids give null."""
    vocabulary = load_vocabulary(model)
    schema = T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                texts = [None if x is None else decode_ids(x, vocabulary) for x in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0).cast(arrow.field(0).type), pa.array(texts, type=arrow.field(1).type)], schema=arrow)

    return encoded.select(id_col, ids_col).mapInArrow(run, schema)
