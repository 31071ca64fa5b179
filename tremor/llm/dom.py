"""HTML pages as trees of blocks, and dense features of their nodes.

The parser follows the rules that decide what belongs to which block: raw text of scripts and styles, comments, quoted attributes, void elements,
end tags that may be left out, stray end tags. Inline elements make no nodes; they only count towards a block's tags and links. A run of
text beside child blocks is a node of its own; a block with text alone holds it itself. Nodes are numbered in page order, parents before children,
and nothing recurses, so neither long nor deep pages are special. Time is linear in the page.
"""

from __future__ import annotations

import functools
import html
import re

import numpy as np

# fixed values: element names
BLOCKS = frozenset(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("button select svg math template object canvas audio video datalist".split())
CONTROLS = frozenset("input button select textarea label".split())
CLOSES_P = BLOCKS - frozenset("caption dd dt legend li summary tbody td tfoot th thead tr".split()) | {"hr"}
#: A start tag ends an open element of these names, unless one of the second group lies between.
ENDS: dict[str, tuple[frozenset, frozenset]] = {
    "li": (frozenset({"li"}), frozenset("ul ol menu dir table".split())),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl", "table"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl", "table"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    **{x: (frozenset("tbody thead tfoot caption".split()), frozenset({"table"})) for x in ("tbody", "thead", "tfoot")},
}
CELLS = frozenset({"td", "th", "caption"})
TABLE_PARTS = frozenset("table tbody thead tfoot tr td th caption".split())

# fixed values: words in class, id, role and itemprop that speak for and against the main text
TOKENS: dict[str, tuple[str, ...]] = {
    "main": tuple("article post entry content story body text main blog news prose".split()),
    "menu": tuple("nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs sitemap links topbar toolbar".split()),
    "frame": tuple("header masthead banner footer foot copyright colophon legal logo branding contentinfo tagline".split()),
    "side": tuple("sidebar aside side widget widgets rail related recommended recommendations popular trending tagcloud share sharing social follow complementary teaser".split()),
    "notice": tuple("cookie cookies consent notice notices gdpr alert popup modal overlay dialog newsletter subscribe subscription paywall disclaimer".split()),
    "advert": tuple("ad ads adv advert adverts advertisement adsense adsbygoogle sponsor sponsored promo promoted promotion".split()),
    "comment": tuple("comment comments commentlist disqus respond reply replies discussion".split()),
    "form": tuple("form login signin signup search register contact".split()),
}
KINDS = list(TOKENS)
_KIND_OF = {w: 1 << k for k, name in enumerate(KINDS) for w in TOKENS[name]}
MAIN_BIT = 1
AGAINST = (1 << len(KINDS)) - 2
GROUPS = ("p", "heading", "list", "box", "main", "frame", "form", "text", "table", "quote")
_GROUP_OF = {
    "p": 0, **{f"h{k}": 1 for k in range(1, 7)}, **dict.fromkeys("ul ol li dl dt dd dir".split(), 2), "article": 4, "main": 4,
    **dict.fromkeys("nav header footer aside menu search dialog".split(), 5), **dict.fromkeys("form fieldset legend".split(), 6), "#text": 7,
    **dict.fromkeys(TABLE_PARTS, 8), **dict.fromkeys("blockquote pre figure figcaption address".split(), 9),
}
#: What an element's name says, as a token would.
_TAG_BITS = {"nav": 2, "menu": 2, "header": 4, "footer": 4, "aside": 8, "dialog": 16, "form": 128, "search": 128, "article": 1, "main": 1}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")  # a quote counts only behind =
_ATTRIBUTE = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW | HIDDEN}
_PUNCTUATION = re.compile(r"[.,;:!?]")


@functools.lru_cache(maxsize=1 << 16)
def token_bits(attributes: str) -> int:
    """A bit for each kind of word among class, id, role and itemprop."""
    bits = 0
    for value in _ATTRIBUTE.findall(attributes):
        for word in _WORD.findall(value):
            bits |= _KIND_OF.get(word.lower(), 0)
    return bits


class Pages:
    """Nodes of one page after another: lists with an entry for each node; each page begins with a root of its own."""

    def __init__(self) -> None:
        self.roots: list[int] = []
        self.parent: list[int] = []
        self.tag: list[str] = []
        self.bits: list[int] = []
        self.above: list[int] = []
        self.depth: list[int] = []
        self.children: list[int] = []
        self.place: list[int] = []
        self.text: list[str] = []
        self.links: list[int] = []
        self.inline: list[int] = []
        self.controls: list[int] = []

    def _node(self, parent: int, tag: str, bits: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.bits.append(bits)
        if parent < 0:
            self.above.append(0)
            self.depth.append(0)
            self.place.append(0)
        else:
            self.above.append(self.above[parent] | self.bits[parent])
            self.depth.append(self.depth[parent] + 1)
            self.place.append(self.children[parent])
            self.children[parent] += 1
        self.children.append(0)
        self.text.append("")
        self.links.append(0)
        self.inline.append(0)
        self.controls.append(0)
        return len(self.parent) - 1

    def add(self, page: str | None) -> None:
        """Parse a page and append its nodes."""
        source = page or ""
        node = self._node(-1, "#root", 0)
        self.roots.append(node)
        stack: list[tuple[int, str]] = [(node, "#root")]
        is_open: dict[str, int] = {}
        run: list[str] = []  # the text since the last edge of a block
        linked = tags = anchors = 0
        no_closing: set[str] = set()

        def flush(ends: bool) -> None:
            nonlocal linked, tags
            if run:
                words = " ".join("".join(run).split())
                run.clear()
                if words:
                    at = node if ends and not self.children[node] else self._node(node, "#text", 0)
                    self.text[at], self.links[at] = words, min(linked, len(words))
                    self.inline[at] += tags
                    linked = tags = 0
                    return
            self.inline[node] += tags
            linked = tags = 0

        def pop_to(k: int) -> None:
            nonlocal node
            while len(stack) > k:
                flush(True)
                is_open[stack.pop()[1]] -= 1
                node = stack[-1][0]

        at, size = 0, len(source)
        while at < size:
            left = source.find("<", at)
            if left < 0:
                left = size
            if left > at:
                piece = source[at:left]
                if "&" in piece:
                    piece = html.unescape(piece)
                run.append(piece)
                if anchors:
                    linked += len(piece)
                if left == size:
                    break
            found = _TAG.match(source, left)
            if not found:
                after = source[left + 1 : left + 2]
                if after == "!" or after == "?" or (after == "/" and not source[left + 2 : left + 3].isalpha()):
                    if source.startswith("<!--", left):
                        end = source.find("-->", left + 2)  # <!--> is a whole comment
                        at = size if end < 0 else end + 3
                    else:
                        end = source.find(">", left)
                        at = size if end < 0 else end + 1
                elif after.isascii() and after.isalpha() or after == "/":
                    break  # the page ends inside a tag
                else:
                    run.append("<")
                    at = left + 1
                continue
            at = found.end()
            ending, name, attributes = found[1], found[2].lower(), found[3]
            if name in BLOCKS:
                if ending:
                    if not is_open.get(name):
                        continue
                    k = len(stack) - 1
                    while stack[k][1] != name and (stack[k][1] not in CELLS or name in TABLE_PARTS):
                        k -= 1
                    if stack[k][1] == name:
                        pop_to(k)
                        anchors = 0
                    continue
                if name in CLOSES_P and is_open.get("p"):
                    k = len(stack) - 1
                    while stack[k][1] != "p" and stack[k][1] not in CELLS:
                        k -= 1
                    if stack[k][1] == "p":
                        pop_to(k)
                if name in ENDS:
                    ended, barrier = ENDS[name]
                    k = len(stack) - 1
                    while k and stack[k][1] not in ended and stack[k][1] not in barrier:
                        k -= 1
                    if stack[k][1] in ended:
                        pop_to(k)
                flush(False)
                node = self._node(node, name, token_bits(attributes) | _TAG_BITS.get(name, 0))
                stack.append((node, name))
                is_open[name] = is_open.get(name, 0) + 1
                continue
            tags += not ending
            if name == "a":
                anchors = 0 if ending else 1
            elif name == "br":
                run.append(" ")
            elif name == "hr":
                if is_open.get("p") and stack[-1][1] == "p":
                    pop_to(len(stack) - 1)
                flush(False)
            elif not ending:
                if name in CONTROLS:
                    self.controls[node] += 1
                if (name in RAW or name in HIDDEN) and name not in no_closing and not attributes.endswith("/"):
                    closing = _CLOSING[name].search(source, at)
                    if closing:
                        at = closing.end()
                    elif name in ("script", "style", "textarea"):
                        at = size
                    else:
                        no_closing.add(name)
        pop_to(1)
        flush(True)

    def features(self) -> np.ndarray:
        """One row of N_FEATURES numbers for each node."""
        n = len(self.parent)
        parent = np.array(self.parent, dtype=np.int64)
        up = np.where(parent < 0, np.arange(n), parent)
        size = np.ones(n, dtype=np.int64)
        for i in range(n - 1, -1, -1):
            if self.parent[i] >= 0:
                size[self.parent[i]] += size[i]
        first, end = np.arange(n), np.arange(n) + size

        def total(values: np.ndarray) -> np.ndarray:  # over the subtree: its nodes are neighbours
            sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
            return sums[end] - sums[first]

        of = lambda values: np.array(values, dtype=np.float64)
        own = of([len(t) for t in self.text])
        marks = of([len(_PUNCTUATION.findall(t)) if t else 0 for t in self.text])
        spaces = of([t.count(" ") + 1 if t else 0 for t in self.text])
        group = np.array([_GROUP_OF.get(t, 3) for t in self.tag], dtype=np.int64)
        bits, above = np.array(self.bits, dtype=np.int64), np.array(self.above, dtype=np.int64)
        chars, links, words = total(own), total(of(self.links)), total(spaces)
        tags = size + total(of(self.inline))
        root = np.repeat(np.array(self.roots, dtype=np.int64), np.diff([*self.roots, n]))
        whole = np.maximum(chars[root], 1.0)
        sums = np.concatenate([[0.0], np.cumsum(own)])
        before = sums[first] - sums[root]
        siblings = np.array(self.children, dtype=np.float64)[up]
        alike = np.bincount(up * len(GROUPS) + group, minlength=n * len(GROUPS))[up * len(GROUPS) + group]
        share = chars / np.maximum(chars[up], 1.0)
        density = links / np.maximum(chars, 1.0)
        weight = total(of([bool(b & AGAINST) for b in self.bits]))
        columns = [
            of(self.depth), np.log1p(chars), np.log1p(own), density, np.log1p(size), chars / tags, words / np.maximum(total(own > 0), 1.0),
            total(marks) / np.maximum(words, 1.0), chars / np.maximum(words, 1.0), chars / whole, before / whole, (before + chars) / whole, siblings,
            of(self.place) / np.maximum(siblings, 1.0), share, alike / np.maximum(siblings, 1.0), np.log1p(total(group == 0)), np.log1p(total(group == 2)),
            np.log1p(total(group == 1)), np.log1p(total(of(self.controls))), density[up], (chars / tags)[up], np.log1p(chars[up]),
            np.log1p(weight), np.log1p(total(bits & MAIN_BIT)),
        ]
        columns += [(bits >> k) & 1 for k in range(len(KINDS))]
        columns += [(above >> k) & 1 for k in range(len(KINDS))]
        columns += [group == k for k in range(len(GROUPS))]
        return np.stack([np.asarray(c, dtype=np.float64) for c in columns], axis=1)


N_FEATURES = 25 + 2 * len(KINDS) + len(GROUPS)


def kept_nodes(parents: list[int], scores: list[float]) -> list[bool]:
    """The choice of nodes with the largest sum of scores among those that keep a node only with its parent; roots are always kept.

    So nothing is kept inside what goes, and a node with a low score stays if what it holds outweighs that.
    """
    value = list(scores)
    for i in range(len(value) - 1, -1, -1):
        if value[i] > 0 and parents[i] >= 0:
            value[parents[i]] += value[i]
    kept = [False] * len(value)
    for i, p in enumerate(parents):
        kept[i] = p < 0 or (kept[p] and value[i] > 0)
    return kept
