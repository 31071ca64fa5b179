"""HTML extraction: gradient-boosted trees over the nodes of a page's tree, and a choice of nodes without contradictions.

A page becomes a tree of blocks (dom). Each node has features: how dense text and links are in its subtree, words in class, id and role of itself and of
what it lies in, its depth, its place among its siblings and its share of parent and page. Trees give the log odds that a node holds main text. The
choice keeps a node only with all its ancestors and has the largest sum of log odds, by one pass up and one down: nothing stays inside
what goes, and a doubtful container stays for what it holds.

Learning: at most `max_pages` pages (a documented bound; those with the smallest hash of id and address), each in `variants` layouts of its own
texts, labelled by where the page's markup puts its main text (layouts). The sample's keys are bounded, so they go to every task and the pages are
only scanned; features are made in tasks and trees are fitted by Spark. Extraction parses and scores whole pages inside tasks, without a shuffle.

The text: character references are decoded, white space inside a block (line breaks and no-break spaces included) becomes one space, blocks
are trimmed and joined in page order by a line feed. Nothing is dropped for its length.

Defined cases: a null or empty page, and one without main text, gives an empty text; a page without any markup is main text; text that
stands in no block at all is kept with the page; unclosed elements end where their parents do, an unclosed script or comment at the page's
end, a tag without an end at the page's end is no text; with no labelled nodes of either class, names alone decide (every main or neutral
name for, every other against); repeated rows repeat; an empty table gives an empty result; further columns stay.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.llm.common import append_columns, map_texts, materialize
from tremor.llm.dom import AGAINST, Pages, kept_nodes
from tremor.llm.layouts import labelled_nodes


class Trees:
    """A sum of regression trees in arrays: inner nodes have a feature, a threshold and two next nodes, leaves point to themselves."""

    def __init__(self, roots: list[int], feature: list[int], threshold: list[float], left: list[int], right: list[int], value: list[float], depth: int) -> None:
        self.roots, self.feature, self.threshold = roots, np.array(feature), np.array(threshold)
        self.left, self.right, self.value, self.depth = np.array(left), np.array(right), np.array(value), depth

    @staticmethod
    def of(model) -> Trees:
        """The trees of a fitted GBTClassificationModel with their weights."""
        roots, feature, threshold, left, right, value = [], [], [], [], [], []
        deepest = 0
        for tree, weight in zip(model.trees, model.treeWeights, strict=True):
            todo = [(tree._call_java("rootNode"), None, None, 0)]
            roots.append(len(feature))
            while todo:
                node, parent, side, depth = todo.pop()
                at = len(feature)
                if parent is not None:
                    side[parent] = at
                leaf = node.getClass().getSimpleName() == "LeafNode"
                feature.append(0 if leaf else node.split().featureIndex())
                threshold.append(np.inf if leaf else node.split().threshold())
                left.append(at)
                right.append(at)
                value.append(weight * node.prediction() if leaf else 0.0)
                deepest = max(deepest, depth)
                if not leaf:
                    todo += [(node.leftChild(), at, left, depth + 1), (node.rightChild(), at, right, depth + 1)]
        return Trees(roots, feature, threshold, left, right, value, deepest)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return 2.0 * out


def extract(pages: list[str | None], trees: Trees | None) -> list[str]:
    """The main texts of some pages."""
    nodes = Pages()
    for page in pages:
        nodes.add(page)
    if trees is None:
        scores = [-1.0 if (own | above) & AGAINST else 1.0 for own, above in zip(nodes.bits, nodes.above, strict=True)]
    else:
        scores = trees.log_odds(nodes.features()).tolist()
    kept = kept_nodes(nodes.parent, scores)
    edges = [*nodes.roots, len(kept)]
    return ["\n".join(t for t, k in zip(nodes.text[a:b], kept[a:b], strict=True) if t and k) for a, b in zip(edges, edges[1:], strict=False)]


def learn_trees(pages: DataFrame, max_pages: int = 500, variants: int = 8, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> Trees | None:
    """Trees learned from a bounded sample; None where it has not both kinds of nodes."""
    keyed = pages.select(F.xxhash64(id_col, url_col).alias("__key"), F.col(html_col).alias("__html"))
    some = keyed.select("__key").distinct().orderBy("__key").limit(max_pages)
    sample = keyed.join(F.broadcast(some), "__key").groupBy("__key").agg(F.min("__html").alias("__html"))  # partial minima first: copies of a key stay where they are
    schema = T.StructType([T.StructField("__features", T.ArrayType(T.DoubleType())), T.StructField("__label", T.DoubleType())])

    def run(_, found):
        rows, labels = [], []
        for page in found:
            r, y = labelled_nodes(page, variants)
            rows += r
            labels += y
        return {"__features": rows, "__label": labels}

    nodes = materialize(map_texts(sample.repartition(16, "__key"), run, schema), "html-nodes")
    counts = {r["__label"]: r["n"] for r in nodes.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    learner = GBTClassifier(featuresCol="__vector", labelCol="__label", maxDepth=5, maxIter=30, stepSize=0.3, maxBins=64, seed=11)
    return Trees.of(learner.fit(nodes.select(array_to_vector("__features").alias("__vector"), "__label").repartition(8)))


def with_main_text(pages: DataFrame, trees: Trees | None, html_col: str = "html") -> DataFrame:
    """pages with a column __text."""
    return append_columns(pages, html_col, lambda found: {"__text": extract(found, trees)}, [T.StructField("__text", T.StringType())])


def extraction_report(pages: DataFrame, max_pages: int = 500) -> DataFrame:
    """Learn, and extract every page's main text."""
    made = with_main_text(pages.select("page_id", "url", "html"), learn_trees(pages, max_pages))
    return made.select("page_id", "url", F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"))


#: The main text of the given table's pages, whose articles hold nothing but blocks of text: what stands in article, cut at block tags.
SQL = r"""
WITH found AS (
  SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS inside FROM pages
), blocks AS (
  SELECT page_id, url, list_transform(string_split_regex(inside, '</?(?:p|h1)>'), lambda x: trim(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&lt;?', '<', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS b
  FROM found
)
SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10)) AS text, length(array_to_string(list_filter(b, lambda x: x <> ''), chr(10))) AS n_chars FROM blocks
"""
