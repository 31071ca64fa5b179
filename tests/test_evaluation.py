"""Dataset index, workbooks and evaluation against plain versions."""

import hashlib
import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.operators import aggregates as A
from tremor.operators import dataset_index as X
from tremor.operators import detection as D
from tremor.operators import folds as L
from tremor.operators import learning
from tremor.sources import workbooks


def sheet(rows, shared):
    """A sheet's XML; texts go through the shared table, every third one inline."""
    out = []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, v in enumerate(row):
            ref = f"{chr(65 + c)}{r}"
            if v is None:
                continue
            if isinstance(v, str) and (r + c) % 3 == 0:
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>')
            elif isinstance(v, str):
                shared.append(v)
                cells.append(f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>')
            else:
                cells.append(f'<c r="{ref}"><v>{v!r}</v></c>')
        out.append(f'<row r="{r}">{"".join(cells)}</row>')
    return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(out)}</sheetData></worksheet>'


def workbook(sheets):
    data, shared = io.BytesIO(), []
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(data, "w") as z:
        for k, (_, rows) in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", sheet(rows, shared))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, (n, _) in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><r><t>{t[:1]}</t></r><r><t>{t[1:]}</t></r></si>" for t in shared) + "</sst>")
    return data.getvalue()


SHEETS = [
    ("rod2p5inch", [["RPM ", "DOC (in)", "State", None, "Feed"], [570, 0.015, "No chatter", "x", 0.004], [570, 0.015, "chatter"], ["bad", 0.015, "chatter"], [600, None, "chatter"]]),
    ("notes", [["comment"], ["nothing here"]]),
    ("cut_3p5", [["spindle speed", "corrected doc (in)", "chatter/nochatter", "L/D"], [320.0, 0.02, "mild", 3.46], [320, 0.0204, "", None]]),
    ("recording times", [["rpm", "doc", "state"], [1, 1, "chatter"]]),
    ("empty", []),
]


def test_workbook_and_index(spark, tmp_path):
    (tmp_path / "book.xlsx").write_bytes(workbook(SHEETS))
    cells = workbooks.workbook_rows(spark, str(tmp_path / "book.xlsx"))
    rows = {r.ord: tuple(r)[1:] for r in X.combinations(cells).collect()}
    assert rows == {0: (2.5, 570.0, 0.015, 0.004, "stable"), 1: (2.5, 570.0, 0.015, 0.002, "chatter"), 5: (3.46, 320.0, 0.02, 0.002, "incipient"), 6: (3.5, 320.0, 0.0204, 0.002, "chatter")}
    paths = ["2p5inch_stickout/c_570_015.mat", "3p5inch_stickout/s_320_020_2.mat", "3p5inch_stickout/s_320_021.mat", "2inch_stickout/s_570_015.mat", "2inch_stickout/i_570_015s_4.mat", "x/c_1_2.mat", "2inch_stickout/c_570.mat", "2inch_stickout/c_a_b.mat", "2inch_stickout/u_100_001.mat", "2inch_stickout/sub/2inch_stickout/u_100_001.mat"]
    found = {r.path: r for r in X.dataset_index(spark.createDataFrame([(p,) for p in paths], "path string"), X.combinations(cells)).collect()}
    assert len(found) == len(paths)
    said = lambda p: (found[p].label, found[p].match, found[p].ord, found[p].feed_rate)
    assert said(paths[0]) == ("stable", "tight", 0, 0.004)
    assert said(paths[1]) == ("incipient", "loose", 5, 0.002)  # within 0.1 of 3.46, before row 6 in order
    assert said(paths[2]) == ("chatter", "loose", 6, 0.002)
    assert said(paths[3]) == ("stable", "name", None, 0.002) and said(paths[4])[0] == "incipient" and said(paths[8])[0] == "chatter"
    assert found[paths[1]].recording_id == "ld_3.5_rpm_320_doc_0.02_state_s_run_2"
    assert {p: found[p].problem for p in paths if found[p].problem} == {paths[5]: "unknown stick-out folder", paths[6]: "name has too few parts", paths[7]: "speed or depth can't be read", paths[8]: "several paths have this id", paths[9]: "several paths have this id"}


@pytest.mark.parametrize("bands", [[X.Within("a", 0.5), X.Within("b", 1e-3, 0.05), X.Within("c", 1.0, 0.02, strict=True)], [X.Within("a", 1e-9, 1e-9), X.Within("b", 1e-9, 0.09)]])
def test_conditions_within_find_every_pair(spark, bands):
    rng = random.Random(len(bands))
    keys = [b.key for b in bands]

    def value():
        base = rng.choice([0.0, 1.0, 100.0, -3e4, 1e12])
        return rng.choice([base, base * (1 + rng.uniform(-0.12, 0.12)), base + rng.uniform(-1.2, 1.2), base + 0.5, base * 1.05, rng.choice([base, base, base, float("nan"), float("inf"), None])])

    left = [(i, *(value() for _ in keys)) for i in range(700)]
    right = [(i, *(value() for _ in keys)) for i in range(700)]
    make = lambda rows, name: spark.createDataFrame(rows, f"{name} int, " + ", ".join(f"{k} double" for k in keys))
    pairs = X.conditions_within(make(left, "i"), make(right, "j"), bands)
    plan = pairs._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

    def agree(a, b, band):
        if a is None or b is None or a != a or b != b or abs(a) == float("inf") or abs(b) == float("inf"):
            return False
        bound = max(band.relative * max(abs(a), abs(b)), band.absolute)
        return abs(a - b) < bound if band.strict else abs(a - b) <= bound

    want = {(x[0], y[0]) for x in left for y in right if all(agree(x[k + 1], y[k + 1], b) for k, b in enumerate(bands))}
    got = [(r.i, r.j) for r in pairs.select("i", "j").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def fold_rows(seed=1, n=900):
    rng = np.random.default_rng(seed)
    g = rng.choice(["a", "b", "c", "d", "e"], n, p=[0.4, 0.3, 0.2, 0.09, 0.01])
    y = (rng.random(n) < 0.4).astype(int)
    x = rng.normal(size=(n, 4)) * [1, 10, 1e-3, 1] + [1e6, 5, 0, 2]
    x[:, 0] += 0.8 * y
    x[:, 1] += 6 * y + 0.5 * (x[:, 0] - 1e6)
    x[:, 3] = 2.0  # without spread
    return g, y, x


@pytest.mark.parametrize("model", ["full", "diagonal"])
def test_left_out_groups_see_no_model_of_their_own(spark, model):
    """Scores equal those of one fit for each group on the other groups' rows."""
    g, y, x = fold_rows()
    rows = spark.createDataFrame([(i, str(a), int(b), *map(float, v)) for i, (a, b, v) in enumerate(zip(g, y, x, strict=True))] + [(9000, None, 1, 1e6, 5.0, 0.0, 2.0), (9001, "a", None, 1.0, 1.0, 1.0, 1.0), (9002, "a", 1, float("nan"), 1.0, 1.0, 1.0)], "i int, g string, y int, f0 double, f1 double, f2 double, f3 double")
    got = {r.i: r.score for r in L.leave_one_group_out(rows.repartition(7), ["f0", "f1", "f2", "f3"], "y", "g", model).collect()}
    assert set(got) == {*range(len(g)), 9000}
    g, y, x = np.append(g, "none"), np.append(y, 1), np.vstack([x, [1e6, 5.0, 0.0, 2.0]])
    for name in set(g):
        train, test = g != name, g == name
        mean, sd = x[train].mean(0), x[train].std(0)
        sd[sd < 1e-9] = 1
        z = (x - mean) / sd
        z0, z1 = z[train & (y == 0)], z[train & (y == 1)]
        within = (z0 - z0.mean(0)).T @ (z0 - z0.mean(0)) + (z1 - z1.mean(0)).T @ (z1 - z1.mean(0))
        within /= train.sum()
        if model == "diagonal":
            within = np.diag(np.diag(within))
        w = np.linalg.solve(within + L.RIDGE * np.eye(4), z1.mean(0) - z0.mean(0))
        p = 1 / (1 + np.exp(-(z[test] - (z0.mean(0) + z1.mean(0)) / 2) @ w))
        ids = [9000 if i == len(g) - 1 else i for i in np.flatnonzero(test)]
        assert np.allclose([got[i] for i in ids], p, atol=1e-6)


def test_folds_without_two_classes_have_no_score(spark):
    rows = spark.createDataFrame([(1, "a", 1, 0.5), (2, "a", 1, 0.7), (3, "b", 0, 0.1), (4, "b", 0, 0.2)], "i int, g string, y int, f double")
    assert [r.score for r in L.leave_one_group_out(rows, ["f"], "y", "g").collect()] == [None] * 4
    assert L.leave_one_group_out(rows.limit(0), ["f"], "y", "g").count() == 0


def test_importance_falls_on_what_tells_the_classes_apart(spark):
    g, y, x = fold_rows(2, 1500)
    rows = spark.createDataFrame([(i, str(a), int(b), *map(float, v)) for i, (a, b, v) in enumerate(zip(g, y, x, strict=True))], "i int, g string, y int, f0 double, f1 double, f2 double, f3 double")
    found = {r.feature: r.importance for r in L.permutation_importance(rows, ["f0", "f1", "f2", "f3"], "y", "g", ["i"], bucket=100).collect()}
    assert found["f0"] > 0.03 and found["f1"] > 0.03 and abs(found["f2"]) < 0.02 and found["f3"] == 0
    whole = L.pooled_metrics(L.leave_one_group_out(rows, ["f0", "f1", "f2", "f3"], "y", "g")).collect()[0]
    cells = L.auc_by(L.leave_one_group_out(rows, ["f0", "f1", "f2", "f3"], "y", "g").withColumn("c", F.lit(1)), ["c"], "__y", "score").collect()[0]
    assert whole.auc == pytest.approx(cells.auc, abs=1e-3) and whole.auc > 0.6


@pytest.mark.parametrize("ranges", [1, 7, 256])
def test_bootstrap_of_the_area_is_that_of_drawn_rows(spark, ranges):
    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.3).astype(int)
    s = np.round(rng.normal(size=400) + 0.7 * y, 1)  # ties
    rows = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)] + [(None, 1.0), (1, None), (1, float("nan"))], "y int, s double")
    got = D.bootstrap_auc(rows, "y", "s", ranges=ranges, block=8).collect()[0]
    order = np.sort(np.unique(s))

    def area(i):
        at = np.searchsorted(order, s[i])
        pos, neg = (np.bincount(at[y[i] == c], minlength=len(order)) for c in (1, 0))
        return (pos * (np.cumsum(neg) - neg / 2)).sum() / (pos.sum() * neg.sum())

    plain = np.quantile([area(rng.integers(0, 400, 400)) for _ in range(2000)], [0.025, 0.5, 0.975])
    assert np.allclose([got.low, got.median, got.high], plain, atol=0.012) and got.resamples == 2000
    one = D.bootstrap_auc(rows.filter("y = 1"), "y", "s", resamples=10).collect()[0]
    assert one.low is None and one.resamples == 0
    assert D.bootstrap_auc(rows.limit(0), "y", "s", resamples=10).collect()[0].resamples == 0


@pytest.mark.parametrize("alone", [1, 7, 10_000])
def test_exact_quantiles(spark, alone):
    rng = np.random.default_rng(alone)
    groups = {
        "wide": [*rng.lognormal(0, 20, 3000), *(-rng.lognormal(0, 20, 3000))], "same": [4.0] * 500, "two": [1.0, 2.0], "one": [7.5], "hot": [*[3.0] * 4000, *rng.normal(3, 1e-9, 700)],
        "ints": rng.integers(0, 5, 999).astype(float).tolist(), "ends": [float("-inf"), -1.0, 0.0, 5.0, float("inf")],
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("one", None), ("one", float("nan")), ("none", None), (None, 1.0)]
    probabilities = [0.0, 0.25, 0.5, 0.731, 1.0]
    got = {r.g: r.q for r in A.exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), "g", "v", probabilities, alone).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        with np.errstate(invalid="ignore"):
            want = np.quantile(values, probabilities)
        if g == "ends":
            assert got[g][:1] + got[g][2:3] + got[g][4:] == [float("-inf"), 0.0, float("inf")]
        else:
            assert np.allclose(got[g], want, rtol=1e-12), g


def test_split_ranks_like_one_list(spark):
    rows = spark.createDataFrame([(i % 997, int(i % 997 % 5 == 0)) for i in range(5000)] + [(5000, None)], "g int, y int")
    got = {r.g: (r["class"], r.part) for r in D.split_groups(rows, "g", "y").collect()}
    for c in (0, 1, None):
        ranked = sorted((g for g, (k, _) in got.items() if k == c), key=lambda g: (hashlib.md5(f"{g}:7".encode()).hexdigest(), g))
        cut = [int(np.floor(len(ranked) * 0.2 + 0.5))] * 2
        assert [got[g][1] for g in ranked] == ["test"] * cut[0] + ["validation"] * cut[1] + ["train"] * (len(ranked) - 2 * cut[0])
    assert len(got) == 998


def test_radial_margins_tell_rings_apart(spark):
    rng = np.random.default_rng(6)
    y = rng.random(500) < 0.4
    angle, radius = rng.uniform(0, 2 * np.pi, 500), np.where(y, 1.0, 2.5) + rng.normal(scale=0.2, size=500)
    rows = spark.createDataFrame([(f"g{i % 20}", int(c), float(r * np.cos(a)), float(r * np.sin(a))) for i, (c, r, a) in enumerate(zip(y, radius, angle, strict=True))], "g string, y int, a double, b double")
    auc = lambda made: D.roc_auc(made, "label", "score").collect()[0].auc
    radial = learning.calibrated_margins(rows, ["a", "b"], "y", "g", folds=2, dims=64, iterations=10, most_inner=2).cache()
    linear = learning.calibrated_margins(rows, ["a", "b"], "y", "g", folds=2, dims=0, iterations=5, most_inner=2)
    assert auc(radial) > 0.98 > 0.75 > auc(linear)
    assert radial.count() == 500 and radial.groupBy("group").agg(F.count_distinct("fold").alias("n")).filter("n > 1").isEmpty()
    calibrated = radial.agg(F.avg("score").alias("p"), F.avg("label").alias("y")).collect()[0]
    assert calibrated.p == pytest.approx(calibrated.y, abs=0.05)
    with pytest.raises(ValueError):
        learning.calibrated_margins(rows.filter("y = 1"), ["a", "b"], "y", "g", folds=2)


@pytest.mark.parametrize("fit", [lambda df: learning.grouped_predictions(df, ["a", "b"], "y", "g", folds=2), lambda df: learning.calibrated_margins(df, ["a", "b"], "y", "g", folds=2, dims=0, iterations=2, most_inner=2)])
def test_folds_make_their_rows_once(spark, fit):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    rows = spark.range(200).select((F.col("id") % 20).alias("g"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"), (F.col("id") % 2).cast("int").alias("y"))
    assert fit(rows.mapInPandas(counted, rows.schema)).count() == 200
    assert made.value == 200


def test_scores_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    rows = spark.range(90).select((F.col("id") % 9).alias("g"), (F.col("id") % 2).cast("int").alias("__y"), (F.col("id") / 90.0).alias("score"))
    got = L.pooled_metrics(rows.mapInPandas(counted, rows.schema)).collect()[0]
    assert got.tp + got.fp + got.fn + got.tn == 90 and 0.4 < got.auc < 0.6
    assert made.value == 90


def test_files_without_a_match_do_not_meet_in_one_task(spark):
    """Facts are joined to distinct conditions, so no join or shuffle of all files has ord as its key."""
    files = spark.range(40).select(F.concat(F.lit("2inch/s_320_"), F.lpad((F.col("id") % 20).cast("string"), 3, "0"), F.lit("_"), F.col("id").cast("string"), F.lit(".mat")).alias("path"))
    metadata = spark.createDataFrame([(7, 2.0, 320.0, 0.001, 0.004, "stable")], "ord long, stickout double, rpm double, depth_of_cut double, feed_rate double, label string")
    made = X.dataset_index(files, metadata)
    assert sorted({(r.ord, r.match, r.feed_rate) for r in made.collect()}, key=repr) == [(7, "tight", 0.004), (None, "name", 0.002)]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    left = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    assert len(left) == 2 and not any("ord#" in line for line in left)
