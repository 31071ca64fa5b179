"""Flattened documents and resumed runs against plain versions."""

import json
import random
import re

from pyspark.sql import types as T

from tremor.operators import documents as D
from tremor.operators import runs as R


def plain(v, prefix=""):
    items = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ()
    for k, child in items:
        name = re.sub(r"[^a-z0-9]+", "_", str(k).lower()).strip("_")
        path = f"{prefix}_{name}" if prefix else name
        yield path, child
        yield from plain(child, path)


def test_flattened(spark):
    rng = random.Random(2)

    def value(depth):
        kind = rng.random()
        if depth and kind < 0.35:
            return {rng.choice(["A b", "c-D", "e", "RPM (1/min)", "x9"]) + str(i): value(depth - 1) for i in range(rng.randint(0, 3))}
        if depth and kind < 0.6:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        return rng.choice([None, True, 3, 2.5, "text", "", "ü 漢"])

    docs = [{"a": value(5), "b": value(3)} for _ in range(60)]
    deep = "1"
    for _ in range(40):
        deep = f'{{"d":[{deep}]}}'
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(100, "{broken"), (101, None), (102, "5"), (103, "[]"), (104, deep)]
    got = D.flattened(spark.createDataFrame(rows, "i int, d string"), "i", "d").collect()
    want = sorted((i, p) for i, d in enumerate(docs) for p, _ in plain(d)) + sorted((104, p) for p, _ in plain(json.loads(deep)))
    assert sorted((r.i, r.path) for r in got) == want
    said = {(r.i, r.path): r for r in got}
    for i, d in enumerate(docs):
        for path, v in plain(d):
            r = said[i, path]
            if isinstance(v, (dict, list)):
                assert r.kind == ("object" if isinstance(v, dict) else "array") and json.loads(r.value) == v
            else:
                assert r.value == (None if v is None else str(v).lower() if isinstance(v, bool) else str(v))


def test_requirements(spark):
    docs = [{"metrics": {"mean adjacent IMF correlation": 1}, "n": 1}, {"metrics": {"Max": 1}}, {"n": {"Number of IMFs": 3}}]
    entries = D.flattened(spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, d string"), "i", "d")
    wanted = {"mean": ["mean_correlation"], "count": ["number_of_imfs", "imf_count"], "order": ["correlation_mean"], "part": ["etric"]}
    assert {r.requirement: (r.records, r.missing) for r in D.requirements(entries, "i", wanted).collect()} == {"mean": (3, 2), "count": (3, 2), "order": (3, 3), "part": (3, 1)}


def test_a_run_takes_up_where_the_last_one_stopped(spark, tmp_path):
    folder, calls = str(tmp_path / "run"), str(tmp_path / "calls")
    schema = T.StructType([T.StructField("recording_id", T.StringType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def kernel(x):
        with open(calls, "a") as f:
            f.write(f"{x[0]:g}\n")
        if x[0] < 0:
            raise ValueError("negative")
        return (float(x.sum()),)

    def run(rows, configuration="c"):
        open(calls, "w").close()
        manifest = R.run_dataset(spark.createDataFrame(rows, schema), folder, kernel, [T.StructField("total", T.DoubleType())], configuration)
        found = {r.recording_id: (r.status, r.touched) for r in manifest.collect()}
        results = {r.recording_id: r.total for r in R.stored(spark, f"{folder}/results", "recording_id string, total double, bucket int").collect()}
        return found, results, sorted(open(calls).read().split())

    first = [(f"r{i}", [float(i), 1.0]) for i in range(200)] + [("bad", [-1.0])]
    found, results, worked = run(first)
    assert found == {**{f"r{i}": ("done", True) for i in range(200)}, "bad": ("failed", True)} and results == {f"r{i}": i + 1.0 for i in range(200)} and len(worked) == 201
    found, results, worked = run(first)  # nothing has changed: only the failed one is tried again
    assert worked == ["-1"] and found["bad"] == ("failed", True) and sum(t for _, t in found.values()) == 1 and len(results) == 200
    second = [("r3", [50.0]), *first[4:200], ("new", [7.0]), ("bad", [2.0]), ("r5", [9.0])]  # r0 to r2 are gone, r5 is there twice
    found, results, worked = run(second)
    assert sorted(worked) == ["2", "50", "7"] and found["r3"] == ("done", True) and found["r5"][0] == "failed" and found["bad"] == ("done", True)
    assert not {"r0", "r1", "r2", "r5"} & set(results) and results["r3"] == 50.0 and results["new"] == 7.0 and set(found) == {r[0] for r in second}
    assert len(run(second, "other")[2]) == len({r[0] for r in second}) - 1  # another configuration: all but the doubled one
    found, results, worked = run([])
    assert found == {} and results == {} and worked == []
