"""Secret scan by assignment-aware lexing.

Three fixed patterns give the base findings. On top of them a small lexer reads every ``name op expression`` of source
and configuration syntax (``a = "x"``, ``"a": "x"``, ``a: x``, ``a := "x"``, ``a => "x"``, ``cfg["a"] = x``, ``<a>x</a>``) into
name-literal pairs, follows names through the text's own constants (plain copies, ``+`` and adjacent literals, also across line
ends, ``${NAME}`` inside quotes) however long the chain, and scores each literal by how sensitive the name is and how little the value
looks like a word or placeholder. A name stands for its nearest setting above, or else its last one below; names that are set by
themselves, also in a circle, stay unknown. Values are kept as character counts with both ends, so long concatenations cost no more
than their terms. A text is read once; nothing is shuffled.

Defined cases: null text counts as empty; an empty text has no findings (base_sha256 is that of the empty string); repeated
rows give repeated results; further columns of the table are ignored; null ids pass through.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.llm.common import map_texts

# Fixed values of the base scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "literal")
_HINTS = ("passw", "secret", "token", "key")

_PAIR = re.compile(r"""(?<![\w.$-])(["'`]?)([A-Za-z_$][\w$]*(?:[.-][\w$]+)*)\1\]?[ \t]*(:=|=>|==|=|:(?!//))[ \t]*""", re.ASCII)
_TAG = re.compile(r"<([A-Za-z_][\w.-]*)>([^<>\s]{6,})</\1>", re.ASCII)
_QUOTED = re.compile(r"""[rRbBuUfF]{0,2}("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`)""")
#: An unquoted value ends at & ; , and at =, unless nothing but = is left of it.
_BARE = re.compile(r"[A-Za-z0-9+/_.$~!@#%^*-]+(?:=+(?![A-Za-z0-9+/_.=$~!@#%^*-]))?", re.ASCII)
_NAME = re.compile(r"[A-Za-z_$][\w$]*(?:\.[\w$]+)*", re.ASCII)
_INNER = re.compile(r"\$\{([A-Za-z_][\w.]*)\}", re.ASCII)
_BREAK = r"(?:\\?\r?\n[ \t]*)?"
_JOIN = re.compile(rf"[ \t]*(?:{_BREAK}(?:\+|\.\.)[ \t]*{_BREAK}|\\\r?\n[ \t]*)?(?=[\"'`A-Za-z_$])")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: How sensitive a word in a target name is.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 0.9, "credential": 0.9, "credentials": 0.9,
    "key": 0.5, "private": 0.5, "api": 0.4, "access": 0.3, "auth": 0.6, "bearer": 0.8, "signature": 0.5, "cookie": 0.5, "session": 0.4, "salt": 0.5, "pin": 0.5,
}
PLACEHOLDER = re.compile(r"(?i)^(?:change.?me|example.*|your[-_ ].*|<.*>|x{3,}|\*{3,}|\.{3,}|none|null|nil|true|false|todo|test|dummy|placeholder|\$\{.*\}|%\(.*\)s|\{\{.*\}\})$")


def name_weight(name: str) -> float:
    """0 to 1: one less the product of what each sensitive word of the name leaves."""
    rest = 1.0
    for w in _WORDS.findall(name):
        rest *= 1.0 - SENSITIVE.get(w.lower(), 0.0)
    return 1.0 - rest


class Value(NamedTuple):
    """A string by its length, character counts and both ends (ENDS characters each)."""

    n: float
    counts: dict[str, float]
    head: str
    tail: str


ENDS = 32
#: Counts stop here: chains of doublings would outgrow any number, and a weight reaches its maximum long before.
MOST = 1e12


def value_of(text: str) -> Value:
    return Value(len(text), Counter(text), text[:ENDS], text[-ENDS:])


def concatenated(parts: list[Value]) -> Value:
    if len(parts) == 1:
        return parts[0]
    counts: dict[str, float] = {}
    head = tail = ""
    for p in parts:
        for c, k in p.counts.items():
            counts[c] = min(MOST, counts.get(c, 0) + k)
        head = (head + p.head)[:ENDS] if len(head) < ENDS else head
        tail = (tail + p.tail)[-ENDS:]
    return Value(sum(counts.values()), counts, head, tail)


def value_weight(value: str | Value) -> float:
    """0 to 1: total character entropy against 64 bits; placeholders and values under 6 characters are 0."""
    n, counts, head, tail = value_of(value) if isinstance(value, str) else value
    if n < 6:
        return 0.0
    whole = head if n <= ENDS else head + tail[-int(min(n - ENDS, ENDS)) :]
    if PLACEHOLDER.match(whole) and not (n > 2 * ENDS and len(counts) > 1 and set(whole.lower()) <= set("x*.")):
        return 0.0
    bits = -sum(c / n * math.log2(c / n) for c in counts.values())
    return min(1.0, n * bits / 64.0)


def _expression(text: str, at: int) -> list[tuple[str, str, int, int]]:
    """Terms of the expression at a position: (kind, value, start, end), kind lit, bare or name."""
    terms: list[tuple[str, str, int, int]] = []
    while True:
        if m := _QUOTED.match(text, at):
            terms.append(("lit", m[1][1:-1], m.start(1) + 1, m.end(1) - 1))
        elif terms and (m := _NAME.match(text, at)):
            terms.append(("name", m[0], m.start(), m.end()))
        elif not terms and (m := _BARE.match(text, at)):
            value = m[0].rstrip(".")
            plain = _NAME.fullmatch(value) and not any(c.isdigit() for c in value)
            terms.append(("name" if plain else "bare", value, m.start(), m.start() + len(value)))
        else:
            break
        at = terms[-1][3] + (terms[-1][0] == "lit")
        more = _JOIN.match(text, at)
        if not more or (more[0].strip() == "" and not (terms[-1][0] == "lit" and more.end() < len(text) and text[more.end()] in "\"'`")):
            break
        at = more.end()
    return terms


def literal_spans(text: str, threshold: float = 0.5) -> tuple[set[tuple[int, int]], float]:
    """Spans of the literals that reach a sensitive name, and the highest score of all."""
    pairs = []
    if "=" in text or ":" in text:
        at = 0
        while m := _PAIR.search(text, at):
            at = m.end()
            if m[3] != "==" and (terms := _expression(text, at)):
                pairs.append((m[2], terms))
                if terms[0][0] == "lit" or not _PAIR.match(text, at):  # of a = b = "x", b is set as well
                    at = terms[-1][3]
    if "</" in text:
        pairs += [(m[1], [("bare", m[2], m.start(2), m.end(2))]) for m in _TAG.finditer(text)]
    if not pairs:
        return set(), 0.0
    graph = _Constants(pairs)
    found: set[tuple[int, int]] = set()
    taken: set[int] = set()
    top = 0.0
    for i, (name, _) in enumerate(pairs):
        if (w := name_weight(name)) and (value := graph.value(i)) and (v := value_weight(value)):
            score = w * (0.4 + 0.6 * v)
            top = max(top, score)
            if score >= threshold:
                graph.collect(i, found, taken)
    return found, top


class _Constants:
    """The settings of a text as a graph: each one's value, and the spans of the literals that reach it."""

    def __init__(self, pairs: list[tuple[str, list]]) -> None:
        self.pairs = pairs
        self.places: dict[str, list[int]] = {}
        for i, (name, _) in enumerate(pairs):
            self.places.setdefault(name, []).append(i)
        self.values: dict[int, Value | None] = {}
        self.spans: dict[int, list[tuple[int, int]]] = {}
        self.uses: dict[int, list[int]] = {}

    def setting(self, name: str, i: int) -> int | None:
        """What a name in setting i stands for: its nearest setting above, or else its last one below."""
        places = self.places.get(name)
        if not places or name == self.pairs[i][0]:
            return None
        return places[bisect_left(places, i) - 1]  # none above: -1 is the last one

    def names(self, i: int) -> list[str]:
        out = []
        for kind, v, _, _ in self.pairs[i][1]:
            out += [v] if kind == "name" else _INNER.findall(v) if kind == "lit" and "${" in v else []
        return out

    def value(self, start: int) -> Value | None:
        """The value of a setting, None if a name in it is unknown. What it needs is worked out first, without recursion."""
        todo, entered = [start], set()
        while todo:
            i = todo[-1]
            if i in self.values:
                todo.pop()
                continue
            needs = [j for name in self.names(i) if (j := self.setting(name, i)) is not None and j not in self.values and j not in entered] if i not in entered else []
            entered.add(i)
            if needs:
                todo += needs
                continue
            todo.pop()
            self.values[i] = self._evaluate(i)
        return self.values[start]

    def _evaluate(self, i: int) -> Value | None:
        parts: list[Value] = []
        spans: list[tuple[int, int]] = []
        uses: list[int] = []

        def known(name: str) -> bool:
            j = self.setting(name, i)
            if j is None or self.values.get(j) is None:  # of a circle, the settings that are still open
                return False
            parts.append(self.values[j])
            uses.append(j)
            return True

        terms = self.pairs[i][1]
        for kind, v, lo, hi in terms:
            if kind == "name":
                if known(v):
                    continue
                if len(terms) == 1 and hi - lo >= 12:  # names nothing in this text: an unquoted value
                    parts.append(value_of(v))
                    spans.append((lo, hi))
                    continue
                return None
            if kind == "lit" and "${" in v:
                done = 0
                for m in _INNER.finditer(v):
                    parts.append(value_of(v[done : m.start()]))
                    if not known(m[1]):
                        parts.append(value_of(m[0]))
                    done = m.end()
                v = v[done:]
            parts.append(value_of(v))
            spans.append((lo, hi))
        self.spans[i], self.uses[i] = spans, uses
        return concatenated(parts)

    def collect(self, start: int, found: set[tuple[int, int]], taken: set[int]) -> None:
        """Adds the spans of all literals that reach a setting; taken: settings done before."""
        todo = [start]
        while todo:
            i = todo.pop()
            if i not in taken:
                taken.add(i)
                found.update(s for s in self.spans[i] if s[1] > s[0])
                todo += self.uses[i]


def scan_text(text: str | None, threshold: float = 0.5) -> tuple[list[tuple[int, int, int]], float]:
    """All spans of a text as (start, index in KINDS, end), sorted, and the best literal score."""
    text = text or ""
    spans: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    literals, top = literal_spans(text, threshold)
    spans += [(lo, 3, hi) for lo, hi in literals]
    spans.sort()
    return spans, top


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{lo}:{hi}" for lo, k, hi in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: id, array of findings (kind, start, end, value) and the best literal score."""
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType),
        T.StructField("findings", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.StringType())]))),
        T.StructField("literal_score", T.DoubleType()),
    ])

    def run(ids, texts):
        found, tops = [], []
        for t in texts:
            spans, top = scan_text(t, threshold)
            found.append([{"kind": KINDS[k], "start": lo, "end": hi, "value": t[lo:hi]} for lo, k, hi in spans])
            tops.append(top)
        return {id_col: ids, "findings": found, "literal_score": tops}

    return map_texts(docs.select(id_col, text_col), run, schema)


def secret_digest(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The findings of scan_secrets per document as counts, the digest of the base spans, and the joined span list."""
    found = scan_secrets(docs, threshold=threshold)
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("findings", lambda x: x["kind"] != "literal")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, one), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("findings", one), ",").alias("spans"),
        count("literal").alias("n_literal"),
        F.round("literal_score", 6).alias("literal_score"),
    )
