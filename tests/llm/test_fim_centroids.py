"""Fill-in-the-middle and centroid clustering against plain versions and SQL, and on the defined cases."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.compare import differences
from tremor.llm import centroids, fim, queries
from tremor.llm.common import table


def plain_fim(key, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    g = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((g[0] % (n + 1), g[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or g[2] % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if g[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


TEXTS = st.lists(st.sampled_from(["a", "Zz", "é", "\n", " ", "<", "P", ">", "<P>", "<M", "漢", "😀", "\0", "1", "@", "[", "`", "{"]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, max_size=30), st.integers(0, 5))
def test_kernel_is_the_plain_transformation(texts, skip):
    draws = [hashlib.sha256(f"1:{i}".encode()).hexdigest() for i in range(len(texts))][skip:]
    h = [np.array([int(x[8 * k : 8 * k + 8], 16) for x in draws], dtype=np.int64) for k in range(4)]
    made = fim.transform(pa.array(texts, type=pa.string()).slice(skip), h)
    got = list(zip(*(c.to_pylist() for c in made.values()), strict=True))
    assert [(n, form, a, b, out) for n, form, a, b, out in got] == [plain_fim(i, t) for i, t in enumerate(texts)][skip:]


def test_fim_rows_and_restoring(spark, docs):
    rng = random.Random(3)
    parts = ["a", "bc", "é", "\n", " ", "<S", "<", ">", "P>", "<P>", "漢", "😀"]
    rows = [(i, "".join(rng.choice(parts[:9] if i % 3 else parts) for _ in range(rng.choice([0, 1, 5, 40])))) for i in range(400)]
    rows += [(None, "a b c"), (None, "a b c"), (7, None), (8, ""), (9, "word and 漢 " * 600_000), (10, "x" * 5_000_000)]
    made = fim.fill_in_middle(docs(rows, extra=True).withColumn("form", F.lit("clash")))
    again = made.select("doc_id", "text", "form", "score", "__units", "__form", "__prefix_chars", "__middle_chars", "__output", fim.restored(F.col("__output"), F.col("__form")).alias("back")).collect()
    assert len(again) == len(rows)
    for r in again:
        assert tuple(r[4:9]) == plain_fim(r.doc_id, r.text)
        assert r.back == (r.text or "") and r.form == "clash" and r.score == "x"
    assert {r["__form"] for r in again} == {"plain", "psm", "spm"}
    assert fim.fim_report(docs([])).count() == 0


@pytest.mark.parametrize("name", ["op3_ngram_jaccard", "op11_fill_in_middle", "op13_centroid_clustering"])
def test_matches_sql(spark, sf_dir, name):
    assert differences(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name], sf_dir) == ""


@pytest.mark.parametrize("spread", [2, 40, 3000, 2**25])
@pytest.mark.parametrize("b", [1, 4, 10])
def test_bounds_never_change_an_assignment(spread, b):
    """Rounds of moving centroids, with ties and copies; every cluster is that of all distances."""
    rng = np.random.default_rng(spread + b)
    x = rng.integers(-spread, spread + 1, (900, 6))
    x[600:] = x[:300]
    c, held, steps, work = x[:24].copy(), None, None, 0
    for turn in range(9):
        want = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        if held is None:
            held, best = centroids.Bounds.scan(x, c, b)
            assert (best == ((x - c[want]) ** 2).sum(1)).all()
        else:
            held.moved(steps)
            held.cut(max(1, b - turn // 2))
            work += int(held.settle(x, c)[1].sum())
        assert (held.own == want).all()
        new = np.array([x[want == j].sum(0) // max(1, (want == j).sum()) if (want == j).any() else c[j] for j in range(len(c))])
        if turn > 5:
            new = c + rng.integers(-1, 2, c.shape)  # small steps: the bounds must certify most rows
        steps, c = np.sqrt(((new - c) ** 2).sum(1).astype(float)) * (1 + 1e-9), new
    if spread == 3000 and b == 10:
        assert work < 0.6 * 8 * x.shape[0] * len(c)


def _vectors(spark, rows):
    return spark.createDataFrame(rows, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("cluster", T.StringType())]))


def test_clustering_cases(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=64).tolist(), "x") for i in range(60)]
    odd = [(100, None, "x"), (101, [], "x"), (102, [1.0] * 63, "x"), (103, [1.0] * 65, "x"), (104, [float("nan")] + [0.0] * 63, "x"), (105, [float("inf")] + [0.0] * 63, "x"), (106, [None] + [0.0] * 63, "x")]
    same = [(3, good[3][1], "y"), (3, [0.5] * 64, "y"), (None, [0.25] * 64, "y"), (200, [1e300] + [-1e300] * 63, "z"), (201, [0.0] * 64, "z"), (202, [-0.0] * 64, "z")]
    got = centroids.cluster_report(_vectors(spark, good + odd + same)).collect()
    assert len(got) == len(good + same)
    want = _plain_clusters([(i, v) for i, v, _ in good + same])
    assert sorted(((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia) for r in got)) == want
    assert len({r.inertia for r in got}) == 1 and got[0].inertia == sum(w[3] for w in want)
    few = centroids.cluster_report(_vectors(spark, good[:3])).collect()
    assert sorted(r.cluster for r in few) == [0, 1, 2] and {r.distance for r in few} == {0}
    assert centroids.cluster_report(_vectors(spark, odd)).count() == 0
    assert centroids.cluster_report(_vectors(spark, [])).count() == 0


def _plain_clusters(rows, k=40, rounds=5):
    bound = 2**26
    x = np.array([[int(np.floor(min(bound, max(-bound, c * 256)))) for c in v] for _, v in rows], dtype=object)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, hashlib.sha256(f"2:{rows[i][0]}".encode()).hexdigest(), list(x[i])))
    c = [list(x[i]) for i in order[:k]]
    for turn in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(v, m, strict=True)) for m in c] for v in x]
        own = [row.index(min(row)) for row in d]
        if turn < rounds:
            for j in range(len(c)):
                members = [x[i] for i in range(len(x)) if own[i] == j]
                if members:
                    c[j] = [sum(m[t] for m in members) // len(members) for t in range(64)]
    dist = [d[i][own[i]] for i in range(len(x))]
    per = [sum(dist[i] for i in range(len(x)) if own[i] == j) for j in range(len(c))]
    return sorted((rows[i][0] is None, rows[i][0] or 0, own[i], dist[i], per[own[i]]) for i in range(len(x)))


def test_clusters_of_the_given_table_do_not_depend_on_partitions(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    one = {tuple(r) for r in centroids.cluster_report(vectors.coalesce(1)).collect()}
    assert one == {tuple(r) for r in centroids.cluster_report(vectors.repartition(13)).collect()}
