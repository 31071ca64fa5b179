"""License scan: exact containment join of text blocks with license templates.

A template is a license notice, and a block any run of words of a text, across line ends, of at most WINDOW times the template's length; both
are sets of words. A block matches a template when it holds at least `threshold` of the template's words. Of matches that overlap, the one
with most of the template's words counts, then the first, from its first to its last such word. The join is exact and filters before it verifies:

* global frequency order: the corpus counts of all template words (over every document) order them, rarest first;
* prefix filter: with overlap o = ceil(threshold * |template|), a match must hold one of the template's first |template| - o + 1 words;
* length filter: a text of fewer than o words cannot match;
* positional filter: only words within a block's length of such a word are looked at.

Templates are a fixed, small parameter, so their prefix index goes to every task and the documents are never shuffled; the
only shuffle is the count of template words, at most one row for each word and task.

Defined cases: null text counts as empty (0 words, no labels, score 0); an empty text or table gives empty results; several
equal labels count once; repeated rows repeat; further columns are ignored. Words, lower-casing and the base phrases are
fixed by the scan's definition: A-Z lower-cased, every ASCII character but digits and letters separates.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.llm.common import map_texts, spans_of

#: Longest block, as a multiple of the template's words: leaves room for names, years and words of comment marks between them.
WINDOW = 2

# Fixed values of the base scan: phrase and label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices of well-known public licenses, as label and text.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "You may obtain a copy of the License at http www apache org licenses LICENSE 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Licensed under the BSD License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("proprietary", "Copyright All rights reserved. No part may be reproduced without permission"),
]

#: Whole texts of short public licenses, without the lines that name years and holders.
WHOLE = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES "
        "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
]
TEMPLATES += WHOLE

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_FOLD_LINES = bytes(10 if c == 10 else x for c, x in enumerate(_FOLD))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class TemplateIndex:
    """Templates with their words in global frequency order, and which templates a prefix word belongs to."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[bytes, int], threshold: float) -> None:
        self.threshold = threshold
        self.order = {w: (counts.get(w, 0), w) for _, t in templates for w in words_of(t)}
        self.rows = []  # label, words in order, overlap needed, most words of a block
        self.prefix: dict[bytes, list[int]] = {}
        for k, (label, text) in enumerate(templates):
            words = sorted(set(words_of(text)), key=self.order.__getitem__)
            need = max(1, math.ceil(threshold * len(words) - 1e-9))
            self.rows.append((label, words, need, WINDOW * len(words_of(text))))
            for w in words[: len(words) - need + 1]:
                self.prefix.setdefault(w, []).append(k)
        self.probe = [(w, w.decode("utf-8", "surrogatepass")) for w in self.prefix]
        self.starts = sorted(self.prefix)

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """Blocks that contain a template to the threshold: first word, words, template, containment."""
        found = self.prefix.keys() & set(words)
        out = []
        if not found:
            return out
        tried = sorted({k for w in found for k in self.prefix[w]})
        places: dict[bytes, list[int]] = {w: [] for k in tried for w in self.rows[k][1]}
        for at, w in enumerate(words):
            if w in places:
                places[w].append(at)
        for k in tried:
            _, wanted, need, width = self.rows[k]
            if len(words) < need:
                continue
            hits = sorted((at, w) for w in wanted for at in places[w])
            opened = sorted(at for w in wanted[: len(wanted) - need + 1] for at in places[w])
            lo = 0
            while lo < len(opened):  # prefix words whose blocks may overlap go together
                hi = lo + 1
                while hi < len(opened) and opened[hi] - opened[hi - 1] < 2 * width:
                    hi += 1
                near = hits[bisect_left(hits, (opened[lo] - width + 1,)) : bisect_left(hits, (opened[hi - 1] + width,))]
                out += [(at, n, k, both / len(wanted)) for at, n, both in best_blocks(near, need, width)]
                lo = hi
        return out


def best_blocks(hits: list[tuple[int, bytes]], need: int, width: int) -> list[tuple[int, int, int]]:
    """Blocks of at most width words with at least need different ones of hits (place, word), as first word, words and different hits."""
    both = []  # different words of the block that starts at each hit
    inside: Counter = Counter()
    end = 0
    for at, w in hits:
        while end < len(hits) and hits[end][0] < at + width:
            inside[hits[end][1]] += 1
            end += 1
        both.append(len(inside))
        inside[w] -= 1
        if not inside[w]:
            del inside[w]
    out = []
    i = 0
    while i < len(hits):
        if both[i] < need:
            i += 1
            continue
        last = _block_end(hits, i, both[i])
        best = max(range(i, last + 1), key=lambda j: (both[j], -j))
        last = _block_end(hits, best, both[best])
        held = Counter(w for _, w in hits[best : last + 1])
        first = best
        while held[hits[first][1]] > 1:  # the word comes again: the block can start later
            held[hits[first][1]] -= 1
            first += 1
        out.append((hits[first][0], hits[last][0] - hits[first][0] + 1, both[best]))
        i = last + 1
    return out


def _block_end(hits: list[tuple[int, bytes]], i: int, both: int) -> int:
    """The first hit by which the block that starts at hit i holds this many different words."""
    seen = set()
    while True:
        seen.add(hits[i][1])
        if len(seen) == both:
            return i
        i += 1


def template_word_counts(docs: DataFrame, templates: list[tuple[str, str]], text_col: str = "text", id_col: str = "doc_id") -> dict[bytes, int]:
    """How often each template word occurs in all documents: partial counts in tasks, then one small aggregation."""
    vocabulary = frozenset(w for _, t in templates for w in words_of(t))
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def run(_, texts):
        counts: Counter = Counter()
        for t in texts:
            if t:
                counts.update(w for w in words_of(t) if w in vocabulary)
        return {"word": [w.decode("utf-8", "surrogatepass") for w in counts], "n": list(counts.values())}

    rows = map_texts(docs.select(id_col, text_col), run, schema).groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"].encode("utf-8", "surrogatepass"): r["n"] for r in rows}


_BASE = [(re.compile(rb"(?<![^ \n])" + b"[ \n]+".join(p.encode().split()) + rb"(?![^ \n])"), label, p.split()[0].encode()) for p, label in PHRASES.items()]


def scan_text(text: str | None, index: TemplateIndex) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, float]]]:
    """Words; base places as (word position, label); matching blocks as (first word, words, label, containment)."""
    if not text:
        return 0, [], []
    folded = text.encode("utf-8", "surrogatepass").translate(_FOLD_LINES)
    words = folded.split()
    base = []
    places = [(m.start(), label) for pattern, label, first in _BASE if first in folded for m in pattern.finditer(folded)]
    if places:
        data = np.frombuffer(folded, dtype=np.uint8)
        starts, _ = spans_of((data != 32) & (data != 10))
        base = [(int(np.searchsorted(starts, at)), label) for at, label in places]
    blocks = []
    if any(w in folded for w in index.starts):
        blocks = [(at, n, index.rows[k][0], c) for at, n, k, c in index.matches(words)]
    return len(words), sorted(base), blocks


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: number of words, base phrase places, and the blocks that contain a template."""
    index = TemplateIndex(templates, template_word_counts(docs, templates, text_col, id_col), threshold)
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType),
        T.StructField("n_words", T.LongType()),
        T.StructField("base", T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("label", T.StringType())]))),
        T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("label", T.StringType()), T.StructField("containment", T.DoubleType())]))),
    ])

    def run(ids, texts):
        found = [scan_text(t, index) for t in texts]
        return {
            id_col: ids,
            "n_words": [n for n, _, _ in found],
            "base": [[{"word": w, "label": b} for w, b in x] for _, x, _ in found],
            "blocks": [[{"word": w, "n_words": n, "label": b, "containment": c} for w, n, b, c in x] for _, _, x in found],
        }

    return map_texts(docs.select(id_col, text_col), run, schema)


def license_digest(docs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Counts, labels and a score per document; the score is 1 with a base phrase, else the best containment."""
    found = scan_licenses(docs, threshold=threshold)
    starts = F.transform("base", lambda x: x["word"])
    names = lambda col: F.transform(col, lambda x: x["label"])
    listed = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        listed(names("base")).alias("base_labels"),
        listed(F.concat(names("base"), names("blocks"))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda x: x["containment"])), F.lit(0.0))).alias("score"),
        F.size("blocks").cast("long").alias("n_blocks"),
    )
