"""Small exact cases of the operators, file sources and the streaming extension."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.functions.expressions import label_number, path_identifier, safe_identifier, standard_label
from tremor.operators import detection as D
from tremor.operators import learning as L
from tremor.operators import metadata as J
from tremor.operators import modes as M
from tremor.operators import provenance as P
from tremor.operators import windows as W
from tremor.sources import files as X
from tremor.streaming import hysteresis_stream


def scores(spark, values):
    return spark.createDataFrame([(1, n, float(v)) for n, v in enumerate(values)], "recording_id long, n long, p double")


def column(df, name):
    return [r[name] for r in df.orderBy("n").collect()]


def test_smoothing_vectors(spark):
    assert column(W.running_median(scores(spark, [0, 0, 1, 0, 0]), 3), "smoothed") == [0] * 5
    assert column(W.smooth_labels(scores(spark, [0.1, 0.1, 0.9, 0.9, 0.9, 0.1, 0.1])), "label") == [0, 0, 1, 1, 1, 0, 0]
    assert column(W.smooth_labels(scores(spark, [0.1, 0.9, 0.9, 0.1])), "label") == [0] * 4
    plain = W.hysteresis(scores(spark, [0.1, 0.9, 0.5, 0.1]), 0.75, 0.4, value="p")
    assert column(W.minimum_run(plain, 1), "label") == [0, 1, 1, 0]
    assert column(W.running_median(scores(spark, [4, 1, 3, 2]), 2), "smoothed") == [4, 2.5, 2, 2.5]
    with pytest.raises(ValueError):
        W.hysteresis(scores(spark, [0.1]), 0.4, 0.75)


def signal(spark, values, rec=1):
    return spark.createDataFrame([(rec, n, float(v)) for n, v in enumerate(values)], "recording_id long, n long, x double")


def test_segments_and_windows(spark):
    x = [5.0 if 1000 <= n < 2000 else 0.0 for n in range(5000)]
    assert W.max_energy_segment(signal(spark, x), 1000).select("start_index", "end_index").collect()[0] == (1000, 2000)
    assert W.max_energy_segment(signal(spark, [1.0] * 500), 1000).select("start_index", "end_index").collect()[0] == (0, 500)
    b = W.window_bounds(signal(spark, range(2000)), 1000, W.hop_of(1000, 0.5), 1000.0).orderBy("window_index").collect()
    assert [(r.start_index, r.end_index) for r in b] == [(0, 1000), (500, 1500), (1000, 2000)]
    assert W.window_bounds(signal(spark, range(10)), 1000, 500, 1000.0).count() == 0
    flat = W.time_features(W.sliding_windows(signal(spark, [0.0] * 64), 32, 16)).collect()
    assert len(flat) == 3 and all(r.time_crest_factor is None and r.time_kurtosis is None and r.time_rms == 0 for r in flat)


def test_identifiers_and_labels(spark):
    rows = spark.createDataFrame([("  odd/name... ",), ("run-1_a",), ("a.b",), ("a//b",), ("a-/b",)], "s string")
    assert [r[0] for r in rows.select(safe_identifier(F.col("s"))).collect()] == ["odd__name", "run-1_a", "a__b", "a__b", "a-__b"]
    paths = spark.createDataFrame([("folder/sample.mat",), ("___.mat",), ("a/b.mat",), ("a__b.mat",), (".hidden",), ("x/run-1.2.mat",)], "s string")
    assert [r[0] for r in paths.select(path_identifier(F.col("s"))).collect()] == ["folder__sample", "recording", "a__b", "a__b", "hidden", "x__run-1__2"]
    states = spark.createDataFrame([("No chatter observed",), ("nochatter",), ("mild",), ("",), (None,), ("severe",), ("stable",)], "s string")
    assert [r[0] for r in states.select(standard_label(F.col("s"))).collect()] == ["stable", "stable", "incipient", "chatter", "chatter", "chatter", "chatter"]
    assert [r[0] for r in spark.createDataFrame([(" Chatter",), ("1",), (None,), ("stable",)], "s string").select(label_number(F.col("s"))).collect()] == [1, 1, 0, 0]


def test_onset_and_paired_counts(spark):
    step = signal(spark, [0.0] * 100 + [1.0] * 100)  # the distance from the mean is the same everywhere
    assert W.onset(step).collect()[0].onset_index is not None  # but smoothing falls off at the ends
    assert W.onset(signal(spark, [0.0] * 20 + [5.0] + [0.0] * 19)).collect()[0].onset_index == 19
    rows = spark.createDataFrame([(1, 1, 0), (1, 0, 1)], "t int, a int, b int")
    got = D.mcnemar(rows, "t", "a", "b").collect()[0]
    assert (got.b, got.c, got.statistic) == (1, 1, 0.5) and abs(got.p_value - 0.4795001221869535) < 1e-12
    assert D.mcnemar(rows.limit(0), "t", "a", "b").collect()[0].p_value == 1.0


def test_gates_and_weights(spark):
    rows = [(1, 1, 0.5, 0.1, 0.9, 2.0, 0.3, 0.8), (1, 2, None, None, 0.0, 0.0, 0.0, 0.0)]
    t = spark.createDataFrame(rows, "recording_id long, layer int, chatter_ratio double, forced_ratio double, correlation double, energy double, kurtosis_score double, proximity double").withColumns({"kurtosis": F.col("kurtosis_score"), "dominant_proximity": F.col("proximity")})
    g = {r.layer: r.gate for r in M.gates(t).collect()}
    assert abs(g[1] - 1 / (1 + np.exp(-(2 + 1.8 + 0.3 + 0.8 - 0.5 - 1.5)))) < 1e-12 and abs(g[2] - 1 / (1 + np.exp(1.5))) < 1e-12
    w = {r.layer: r.weight for r in M.indicator_weights(t).collect()}
    assert w == {1: 1.0, 2: 0.0}
    zero = t.withColumns({c: F.lit(0.0) for c in ("correlation", "energy", "kurtosis", "dominant_proximity")})
    assert [r.weight for r in M.indicator_weights(zero).collect()] == [0.5, 0.5]
    stable = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.1), (1, 3, 0.7), (1, 1, 0.8), (1, 2, 0.2), (1, 3, 0.6)], "recording_id long, layer int, gate double")
    got = M.gate_stability(stable, 0.5).orderBy("layer").collect()
    assert all(r.unanimous for r in got) and [r.selected for r in got] == [2, 0, 2]


def test_first_metadata_row_wins(spark):
    files = spark.createDataFrame([("first.mat",), ("nested/second.mat",)], "path string")
    meta = spark.createDataFrame([(1, "first.mat", 600.0), (2, "first.mat", 700.0), (3, "nested\\second", 800.0)], "ord long, path string, rpm double")
    assert {r.path: r.rpm for r in J.path_join(files, meta, "ord").collect()} == {"first.mat": 600.0, "nested/second.mat": 800.0}


def test_detection_edges(spark):
    rows = spark.createDataFrame([(1, 1, 0.9), (1, 1, 0.8)], "t int, p int, s double")
    r = D.confusion(rows, "t", "p").collect()[0]
    assert (r.balanced_accuracy, r.precision, r.f1) == (1.0, 1.0, 1.0)
    assert D.roc_auc(rows, "t", "s").collect()[0].auc is None
    ties = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "t int, s double")
    assert D.roc_auc(ties, "t", "s").collect()[0].auc == 0.875


def mat_bytes(matrix, name="tsDS", packed=False):
    def element(kind, body):
        return struct.pack("<II", kind, len(body)) + body + bytes(-len(body) % 8)

    m = np.asarray(matrix, dtype="<f8")
    body = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", *m.shape)) + element(1, name.encode()) + element(9, m.tobytes(order="F"))
    whole = element(14, body)
    if packed:
        z = zlib.compress(whole)
        whole = struct.pack("<II", 15, len(z)) + z
    return b"MATLAB 5.0".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + whole


def test_recording_files(spark, tmp_path):
    m = np.column_stack([np.arange(5) / 10, np.arange(5) ** 2.0])
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.mat").write_bytes(mat_bytes(m))
    (tmp_path / "deep" / "b.mat").write_bytes(mat_bytes(m, packed=True))
    (tmp_path / "c.mat").write_bytes(mat_bytes(m, name="other"))
    (tmp_path / "d.mat").write_bytes(b"no")
    got = {r.path.rsplit("/", 1)[-1]: r for r in X.recordings(spark, str(tmp_path)).collect()}
    assert got["a.mat"].x == got["b.mat"].x == [0.0, 1.0, 4.0, 9.0, 16.0] and got["a.mat"].error is None
    assert got["c.mat"].x is None and "missing" in got["c.mat"].error and got["d.mat"].error
    template = X.metadata_template(X.recordings(spark, str(tmp_path)).select("path")).collect()
    assert len(template) == 4 and len(template[0]) == 10


def test_metadata_table(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("Relative_Path,RPM,Tooth Count,Depth of Cut\na.mat,600,2,0.005\nb.mat,not-a-number,2.5,\n", encoding="utf-8")
    got = {r.path: r for r in X.metadata_csv(spark, str(p)).collect()}
    assert (got["a.mat"].rpm, got["a.mat"].tooth_count, got["a.mat"].depth_of_cut) == (600.0, 2, 0.005)
    assert (got["b.mat"].rpm, got["b.mat"].tooth_count, got["b.mat"].depth_of_cut) == (None, None, None)


def test_streamed_hysteresis_equals_batch(spark, tmp_path):
    values = np.random.default_rng(2).random(60)
    rows = spark.createDataFrame([(r, n, float(v)) for r in (1, 2) for n, v in enumerate(values)], "recording_id long, n long, p double")
    for k in range(3):  # three batches
        rows.filter((F.col("n") >= 20 * k) & (F.col("n") < 20 * k + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = hysteresis_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.recording_id, r.n): r.state for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    expected = {(r.recording_id, r.n): r.state for r in W.hysteresis(rows, 0.75, 0.4, value="p").collect()}
    assert got == expected


def test_settings_and_identity():
    base = {"fs": 100.0, "low": 2, "high": 40, "order": 4, "window_seconds": 1, "overlap": 0.5, "enter": 0.75, "exit": 0.4, "level": 2}
    assert P.settings_errors(base) == []
    assert P.settings_errors(P.merged(base, {"high": 60, "exit": 0.9})) == ["0 < low < high < fs / 2 is needed", "0 <= exit < enter <= 1 is needed"]
    assert P.settings_errors({**base, "order": True}) == ["order is not a number"]
    assert P.merged({"a": {"b": 1, "c": [1, 2]}}, {"a": {"c": [3]}}) == {"a": {"b": 1, "c": [3]}}
    one = P.run_id(base, {"a": "1", "b": "2"}, None, {"v": "1"})
    assert one == P.run_id(dict(reversed(base.items())), {"b": "2", "a": "1"}, None, {"v": "1"})
    assert len({one, P.run_id(base, {"a": "1"}, None, {"v": "1"}), P.run_id(base, {"a": "1", "b": "2"}, "m", {"v": "1"})}) == 3
    assert P.plain({"x": float("nan"), "y": (1, float("inf"))}) == {"x": None, "y": [1, None]}


def test_groups_stay_whole(spark):
    rng = np.random.default_rng(0)
    rows = [(g, float(g % 2 + rng.normal() * 0.2), float(rng.normal()), g % 2) for g in range(12) for _ in range(10)]
    df = spark.createDataFrame(rows, "g long, a double, b double, y int")
    p = L.grouped_predictions(df, ["a", "b"], "y", "g", folds=3)
    assert p.groupBy("group").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    assert p.count() == 120 and p.filter("label = predicted").count() >= 115
    steps = [r.calibrated for r in L.calibration(p, "label", "score").orderBy("boundary").collect()]
    assert steps == sorted(steps) and 0 <= steps[0] and steps[-1] <= 1


def test_small_expressions(spark):
    from tremor.functions import expressions as E

    rows = spark.createDataFrame([({"RPM": "5", "x": "1"}, "a,nan,b", "v 1.2.3-4.5.6"), ({"rpm2": "7"}, "nano,info", "1.2"), ({}, "1 -INF", None), ({"Rpm": None}, "+inf", "10.20.30")], "m map<string,string>, t string, v string")
    got = rows.select(E.first_key(F.col("m"), "rpm", "Speed"), E.has_nonfinite_token(F.col("t")), E.version(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [("5", True, "1.2.3"), (None, False, None), (None, True, None), (None, True, "10.20.30")]
    paths = spark.createDataFrame([("a/c_570_015s.mat",), ("s_3x2.5_.mat",), ("u.mat",)], "p string")
    named = E.evaluation_name(F.col("p"))
    assert [tuple(r) for r in paths.select(named["label"], named["rpm"], named["feed"]).collect()] == [("c", 570.0, 15.0), ("s", 32.5, None), ("u", None, None)]


def test_rankings(spark):
    from tremor.operators import aggregates as A

    rows = spark.createDataFrame([("s1", "a", 0.9, 0.5), ("s1", "b", 0.9, 0.6), ("s2", "a", None, 0.4), ("s2", "b", 0.1, float("nan")), ("s3", "b", float("nan"), 1.0)], "s string, m string, auc double, f1 double")
    assert {r.s: r.m for r in A.best_models(rows, "s", "m", "auc").collect()} == {"s1": "a", "s2": "b", "s3": "b"}
    ranked = {r.m: r for r in A.model_ranking(rows.filter("s <> 's3'"), "s", "m", "auc", ["f1"]).collect()}
    assert (ranked["a"].wins, ranked["a"].place, ranked["b"].wins, ranked["b"].place) == (1, 1, 1, 2) and np.isnan(ranked["b"].f1)


def test_decomposition_validation(spark):
    t = np.arange(64) / 64
    tones = lambda fs: [(k, n, float(v), False) for k, f in enumerate(fs, 1) for n, v in enumerate(np.sin(2 * np.pi * f * t))]
    make = lambda rows: M.decomposition_validation(spark.createDataFrame([(1, *r) for r in rows], "recording_id int, layer int, n int, x double, is_residual boolean"), 64.0).collect()[0]
    down, up, one = make(tones([20, 9, 3])), make(tones([3, 9, 20])), make(tones([5]))
    assert down.frequency_ordering_index > 0.97 and up.frequency_ordering_index < 0.03 and one.frequency_ordering_index == 1
    assert abs(down.orthogonality_index) < 1e-12 and down.mode_mixing_index < 1e-12 and np.allclose(down.energy_percent, 100 / 3)
    same = make(tones([4, 4]))
    assert same.orthogonality_index == pytest.approx(1) and same.mode_mixing_index == pytest.approx(1) and same.frequency_ordering_index in (0, 1)
    silent = make([(k, n, 0.0, False) for k in (1, 2) for n in range(64)])
    assert (silent.orthogonality_index, silent.mode_mixing_index, silent.frequency_ordering_index) == (0, 0, 1) and silent.energy_percent == [0, 0]


def test_digests_of_files_too_large_for_a_row(spark, tmp_path, monkeypatch):
    """Files beyond what one row may hold: bytes of all kinds, line ends at all places, a byte order mark, names that a packed file or a pattern has."""
    monkeypatch.setattr(X, "WHOLE", 1000, raising=False)
    rng = np.random.default_rng(7)
    noise = rng.integers(0, 256, 300_000, dtype=np.uint8).tobytes()
    mark = b"\xef\xbb\xbf"
    contents = {
        "noise.parquet": noise, "ended": noise + b"\n", "ended twice": noise + b"\n\n", "begun": b"\n\r\n" + noise, "marked": mark + noise, "mark [a]%20{b}": mark + noise + b"\n", "marks": mark + mark + noise,
        "lines": b"\n" * 70_000, "returns": b"\r\n" * 40_000, "one line": b"x" * 200_000, "small": b"a\n", "packed.gz": zlib.compress(noise[:3000]), "deep/er/noise.bin": noise[::-1],
    }
    for name, content in contents.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    settings = {"spark.sql.sources.binaryFile.maxLength": "5000", "spark.sql.files.maxPartitionBytes": "20000"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = X.digests(spark, str(tmp_path)).collect()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert sorted((r.sha256, r.length) for r in rows) == sorted((hashlib.sha256(c).hexdigest(), len(c)) for c in contents.values())
    monkeypatch.setattr(X, "WHOLE", 1 << 29)
    assert sorted(map(tuple, X.digests(spark, str(tmp_path)).collect())) == sorted(map(tuple, rows))


def test_no_row_of_a_digest_is_large(spark, tmp_path):
    """Executors read several files at once, so what a row may hold is far below their memory."""
    content = np.random.default_rng(3).integers(0, 256, 80_000_000, dtype=np.uint8).tobytes()
    (tmp_path / "a.parquet").write_bytes(content)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", str(70_000_000))
    try:
        rows = X.digests(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert [(r.sha256, r.length) for r in rows] == [(hashlib.sha256(content).hexdigest(), len(content))]
