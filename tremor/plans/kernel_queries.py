"""Queries on wavelets and the kernels' operators, over the vectors read as recordings of 64 samples at 64 Hz; and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tremor.functions.expressions import r6
from tremor.operators import baselines as N
from tremor.operators import decompose as K
from tremor.operators import modes as M
from tremor.operators import search as R
from tremor.operators import stage4 as S4
from tremor.operators import wavelets as B
from tremor.operators import windows as W
from tremor.operators.tables import shared_folder
from tremor.plans.registry import VECTORS, query
from tremor.plans.spectra import _DFT, INDIC, MODES, PSD
from tremor.sources import files as X
from tremor.sources import signals as S
from tremor.streaming import hysteresis_stream

FS, BAND = 64.0, (8.0, 20.0)
_LO = (-0.12940952255126037, 0.2241438680420134, 0.8365163037378079, 0.48296291314453416)
_HI = (-0.48296291314453416, 0.8365163037378079, -0.2241438680420134, -0.12940952255126037)


def _level(src: str, n: int, j: int, filt: tuple, alias: str) -> str:
    """One level of the db2 transform of (recording_id, n, x) with mirrored ends, as SQL."""
    size = (n + 3) // 2
    terms = " + ".join(f"{f!r} * list_extract(xs, CAST(CASE WHEN 2 * k + 1 - {i} < 0 THEN -(2 * k + 1 - {i}) WHEN 2 * k + 1 - {i} >= {n} THEN 2 * {n} - (2 * k + 1 - {i}) ELSE 2 * k + 2 - {i} END AS INTEGER))" for i, f in enumerate(filt))
    return f"{alias} AS (SELECT recording_id, k AS n, {terms} AS x FROM (SELECT recording_id, list(x ORDER BY n) AS xs FROM {src} GROUP BY 1), (SELECT unnest(range(0, {size})) AS k))"


_DWT = f"""{VECTORS}, {_level('sig', 64, 1, _LO, 'a1')}, {_level('sig', 64, 1, _HI, 'd1')}, {_level('a1', 33, 2, _LO, 'a2')}, {_level('a1', 33, 2, _HI, 'd2')},
co AS (SELECT recording_id, 'cA2' AS band, 2 AS level, x FROM a2 UNION ALL SELECT recording_id, 'cD2', 2, x FROM d2 UNION ALL SELECT recording_id, 'cD1', 1, x FROM d1),
en AS (SELECT recording_id, band, level, count(*) AS count, sum(x * x) AS energy FROM co GROUP BY 1, 2, 3)"""
_SIG = "md AS (SELECT recording_id, median(x) AS m FROM d1 GROUP BY 1), sg AS (SELECT recording_id, greatest(1e-12, median(abs(x - m)) / 0.6745) AS sigma FROM d1 JOIN md USING (recording_id) GROUP BY 1)"
_THR = f"""{_DWT}, {_SIG}, th AS (SELECT recording_id, band, level, sigma, avg(x * x) AS ms, max(abs(x)) AS top, 64 * pow(2, -(level + 1)) AS lo, 64 * pow(2, -level) AS hi FROM co JOIN sg USING (recording_id) WHERE band <> 'cA2' GROUP BY 1, 2, 3, 4),
tb AS (SELECT *, CASE WHEN ms > sigma * sigma THEN sigma * sigma / sqrt(ms - sigma * sigma) ELSE top END AS base, least(1, greatest(0, (least(hi, 20) - greatest(lo, 8)) / (hi - lo))) AS overlap FROM th),
tt AS (SELECT *, 0.5 * overlap + 1.4 * (1 - overlap) AS scale, base * (0.5 * overlap + 1.4 * (1 - overlap)) AS threshold FROM tb)"""


#: The columns of the feature table that the SQL below states.
STATIC = [
    *(f"time_{c}" for c in ("rms", "variance", "std", "peak_to_peak", "mean_absolute", "crest_factor", "kurtosis", "skewness", "impulse_factor", "shape_factor", "clearance_factor", "zero_crossing_rate")),
    *(f"freq_{c}" for c in ("centroid", "spread", "entropy", "peak", "chatter_band_ratio", "spectral_kurtosis", "spindle_harmonic_ratio", "tooth_harmonic_ratio", "harmonics_ratio", "sideband_ratio")),
    *(f"freq_band_energy_ratio_{c}" for c in ("below_chatter", "chatter", "above_chatter")),
    *(f"physics_{c}" for c in ("chatter_band_energy", "frequency_proximity", "spindle_frequency_hz", "tooth_passing_frequency_hz", "peak_to_spindle_harmonic_distance_hz", "peak_to_tooth_harmonic_distance_hz")),
    *(f"physics_{c}" for c in ("sideband_strength", "forced_vibration_energy", "chatter_to_harmonic_energy_ratio")),
    *(f"imf_{c}" for c in ("count", "max_energy_ratio", "centre_freq_mean", "bandwidth_mean", "entropy_mean", "mode_mixing_index", "max_adjacent_correlation", "orthogonality_index", "frequency_ordering_score", "selected_count")),
    "imf1_correlation", "wavelet_high_freq_ratio", "wavelet_entropy",
]
_DFT_PAIR = f"{_DFT.format(s='u', k='recording_id', t='av')}, av2 AS (SELECT recording_id, n, a1 AS x FROM av), {_DFT.format(s='v', k='recording_id', t='av2')}"
#: The wavelet part of the SQL, under names of its own, to stand beside the others.
_BANDS_SQL = _DWT[len(VECTORS) + 2 :].replace("en AS", "enw AS")


def bands(spark, sf_dir):
    return B.coefficients(S.embedding_arrays(spark, sf_dir), "db2", 2)


@query(f"WITH {_DWT} SELECT recording_id, band, level, CAST(count AS INTEGER) AS count, round(energy, 6) AS energy, round(energy / sum(energy) OVER (PARTITION BY recording_id), 6) AS energy_ratio FROM en")
def dwt_energy(spark, sf_dir):
    e = B.energies(bands(spark, sf_dir), ["recording_id"])
    return e.select("recording_id", "band", "level", "count", r6(F.col("energy")).alias("energy"), r6(F.col("energy_ratio")).alias("energy_ratio"))


@query(f"WITH {_DWT}, s AS (SELECT recording_id, band, energy / sum(energy) OVER (PARTITION BY recording_id) AS q FROM en) SELECT recording_id, round(sum(CASE WHEN band IN ('cD1','cD2') THEN q ELSE 0 END), 6) AS high_freq_ratio, round(-sum(q * log2(q)) / log2(3), 6) AS wavelet_entropy FROM s GROUP BY 1")
def wavelet_ratios(spark, sf_dir):
    e, q = B.energies(bands(spark, sf_dir), ["recording_id"]), F.col("energy_ratio")
    return e.groupBy("recording_id").agg(
        r6(F.sum(F.when(F.col("band").isin("cD1", "cD2"), q).otherwise(0.0))).alias("high_freq_ratio"), r6(-F.sum(F.when(q > 0, q * F.log2(q))) / F.log2(F.count("*").cast("double"))).alias("wavelet_entropy")
    )


@query(f"WITH {_DWT}, {_SIG} SELECT recording_id, round(sigma, 6) AS sigma FROM sg")
def mad_sigma(spark, sf_dir):
    return B.noise_sigma(bands(spark, sf_dir), ["recording_id"]).select("recording_id", r6(F.col("sigma")).alias("sigma"))


@query(f"WITH {_THR} SELECT recording_id, band, lo AS low_hz, hi AS high_hz, round(overlap, 6) AS overlap, round(base, 5) AS base_threshold, round(scale, 6) AS scale, round(threshold, 5) AS threshold FROM tt")
def threshold_rows(spark, sf_dir):
    t = B.thresholds(bands(spark, sf_dir), ["recording_id"], FS, BAND)
    five = [F.round(c, 5).alias(c) for c in ("base_threshold", "threshold")]
    return t.select("recording_id", "band", "low_hz", "high_hz", r6(F.col("overlap")).alias("overlap"), r6(F.col("scale")).alias("scale"), *five)


@query(f"WITH {_THR} SELECT recording_id, band, round(sum(x * x), 5) AS energy_before, round(sum(CASE WHEN threshold IS NULL THEN x * x ELSE pow(greatest(abs(x) - threshold, 0), 2) END), 5) AS energy_after, round(sum(CASE WHEN threshold IS NULL THEN x * x ELSE pow(greatest(abs(x) - threshold, 0), 2) END) / sum(x * x), 5) AS energy_ratio FROM co LEFT JOIN tt USING (recording_id, band) GROUP BY 1, 2")
def threshold_energies(spark, sf_dir):
    made = B.threshold_energies(bands(spark, sf_dir), ["recording_id"], FS, BAND)
    return made.select("recording_id", "band", *[F.round(c, 5).alias(c) for c in ("energy_before", "energy_after", "energy_ratio")])


@query(f"WITH {_DWT}, {_SIG} SELECT recording_id, band, round(sum(pow(greatest(abs(x) - 0.5 * sigma, 0), 2)), 6) AS kept_energy, CAST(sum(CASE WHEN abs(x) > 0.5 * sigma THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM co JOIN sg USING (recording_id) WHERE band <> 'cA2' GROUP BY 1, 2")
def soft_threshold(spark, sf_dir):
    b = bands(spark, sf_dir)
    soft = b.filter("band LIKE 'cD%'").join(B.noise_sigma(b, ["recording_id"]), "recording_id").withColumn("s", B.soft_threshold(F.col("c"), 0.5 * F.col("sigma")))
    return soft.select("recording_id", "band", r6(F.aggregate("s", F.lit(0.0), lambda a, v: a + v * v)).alias("kept_energy"), F.size(F.filter("s", lambda v: v != 0)).cast("long").alias("kept"))


@query()
def wavelet_denoise(spark, sf_dir):
    return B.denoise(S.embedding_arrays(spark, sf_dir), "db2", 2, FS, BAND)


@query()
def bandpass_filter(spark, sf_dir):
    return K.bandpass(S.embedding_arrays(spark, sf_dir), 4.0, 24.0, FS)


@query()
def preprocessed(spark, sf_dir):
    """Band-passed, without constant trend, and scaled; the upper cutoff by the rule."""
    return K.preprocess(S.embedding_arrays(spark, sf_dir), 4.0, FS, trend="constant").select("recording_id", "scaled", "scale_factor", "error")


@query()
def envelope_growth(spark, sf_dir):
    return K.envelope_features(S.embedding_arrays(spark, sf_dir), FS)


@query()
def stft_ridge(spark, sf_dir):
    return K.ridge(K.short_time(S.embedding_arrays(spark, sf_dir), FS))


@query()
def ensemble_mode_rows(spark, sf_dir):
    """300 trials and 16 sifts, as many modes as there are."""
    return K.ensemble_modes(S.embedding_arrays(spark, sf_dir))


@query()
def seed_stability(spark, sf_dir):
    return K.seed_stability(S.embedding_arrays(spark, sf_dir), [42, 43, 44], FS, BAND)


@query()
def matched_gate_stability(spark, sf_dir):
    return K.gate_stability(S.embedding_arrays(spark, sf_dir), [42, 43, 44], FS, BAND)


@query()
def cutoff_search(spark, sf_dir):
    """Four cutoffs, three seeds, 15 trials and 16 sifts."""
    return R.cutoff_grid(S.embedding_arrays(spark, sf_dir), [2.0, 3.0, 4.0, 6.0], [42, 43, 44], 24.0, FS, BAND).drop("objective_by_seed")


def _with_metadata(spark, sf_dir):
    """The vectors with a spindle speed (3 to 5 Hz) and tooth count; every eleventh has none."""
    k = F.col("recording_id")
    teeth = F.when(F.pmod(k, F.lit(11)) != 0, F.pmod(k, F.lit(3)) + 1)
    return S.embedding_arrays(spark, sf_dir).select("recording_id", (180.0 + 60 * F.pmod(k, F.lit(3))).alias("rpm"), teeth.cast("double").alias("tooth_count"), "x")


@query()
def full_pipeline_features(spark, sf_dir):
    """All four stages with 300 trials and 16 sifts: 54 static features of every window."""
    return K.features(_with_metadata(spark, sf_dir), 2.0, 28.0, FS, BAND, 32, 16, "db2", 2, 4, 0.5)


@query()
def dynamic_pipeline_features(spark, sf_dir):
    return K.features(_with_metadata(spark, sf_dir), 2.0, 28.0, FS, BAND, 32, 16, "db2", 2, 4, 0.5, dynamic=True)


_TONE = "(0.3 * sin(2 * pi() * 12.3 * n / 64) + 0.1 * cos(2 * pi() * 25.7 * n / 64))"
#: The six measures of column b (denoised) against column a (known) of table ab(recording_id, n, a, b), 64 samples each.
_QUALITY_SQL = """ga AS (SELECT recording_id, coalesce(sum(a * b) / nullif(sum(b * b), 0), 1) AS g FROM ab GROUP BY 1), al AS (SELECT ab.recording_id, n, a, g * b AS b FROM ab JOIN ga USING (recording_id)),
er AS (SELECT recording_id, sqrt(avg(pow(a - b, 2))) AS rmse, 10 * log10(var_pop(a) / var_pop(a - b)) AS snr_db FROM al GROUP BY 1),
sp AS (SELECT recording_id, k, sqrt(pow(sum(a * cos(2 * pi() * k * n / 64)), 2) + pow(sum(a * sin(2 * pi() * k * n / 64)), 2)) AS p, sqrt(pow(sum(b * cos(2 * pi() * k * n / 64)), 2) + pow(sum(b * sin(2 * pi() * k * n / 64)), 2)) AS q FROM al, (SELECT unnest(range(0, 32)) AS k) GROUP BY 1, 2),
sq AS (SELECT recording_id, k, p / (sum(p) OVER w + 1e-12) AS p, q / (sum(q) OVER w + 1e-12) AS q FROM sp WINDOW w AS (PARTITION BY recording_id)),
di AS (SELECT recording_id, sum(abs(p - q)) AS spectral_distortion, sum(q) FILTER (WHERE k BETWEEN 8 AND 20) / sum(p) FILTER (WHERE k BETWEEN 8 AND 20) AS chatter_band_retention, 1 - sum(q) FILTER (WHERE k NOT BETWEEN 8 AND 20) / sum(p) FILTER (WHERE k NOT BETWEEN 8 AND 20) AS noise_band_attenuation FROM sq GROUP BY 1),
en1 AS (SELECT recording_id, n, abs(b - avg(b) OVER (PARTITION BY recording_id)) AS e FROM al), en2 AS (SELECT recording_id, n, sum(e) OVER (PARTITION BY recording_id ORDER BY n ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING) / 50 AS e FROM en1),
on1 AS (SELECT recording_id, n, e > (min(e) OVER (PARTITION BY recording_id) + max(e) OVER (PARTITION BY recording_id)) / 2 AS up FROM en2), on2 AS (SELECT recording_id, n, up <> lead(up) OVER (PARTITION BY recording_id ORDER BY n) AS turned FROM on1),
on3 AS (SELECT recording_id, abs(min(CASE WHEN turned THEN n END) / 64.0 - 0.25) AS onset_detection_error FROM on2 GROUP BY 1)"""


def noisy_vectors(spark, sf_dir):
    """(recording_id, x, reference): two tones as the known signal, and a fifth of the vector as its noise."""
    turn = 2 * 3.141592653589793 / FS
    tone = F.transform("x", lambda v, i: F.sin(turn * 12.3 * i) * 0.3 + F.cos(turn * 25.7 * i) * 0.1)
    rows = S.embedding_arrays(spark, sf_dir).withColumn("reference", tone)
    return rows.withColumn("x", F.zip_with("x", "reference", lambda a, b: 0.2 * a + b))


@query(f"WITH {VECTORS}, ab AS (SELECT recording_id, n, {_TONE} AS a, 0.2 * x + {_TONE} AS b FROM sig), {_QUALITY_SQL} SELECT recording_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in R.QUALITY) + " FROM er JOIN di USING (recording_id) JOIN on3 USING (recording_id)")
def denoising_quality(spark, sf_dir):
    """The six measures of the noisy signal itself."""
    made = R.reference_quality(noisy_vectors(spark, sf_dir).withColumnRenamed("x", "clean"), FS, BAND, 0.25)
    return made.select("recording_id", *(r6(F.col(c)).alias(c) for c in R.QUALITY))


@query()
def wavelet_selection(spark, sf_dir):
    return R.wavelet_choices(noisy_vectors(spark, sf_dir), [("db1", 2), ("db2", 2), ("db4", 2)], FS, BAND)


@query()
def denoising_benchmark(spark, sf_dir):
    """Eight methods at two levels of noise; each vector is the known signal of a recording."""
    rows = S.embedding_arrays(spark, sf_dir).withColumnRenamed("x", "reference")
    return N.benchmark(rows, [0.1, 0.5], FS, (2.0, 28.0), BAND, "db2", 2, ("db2", 2))


_META = "md AS (SELECT vec_id AS recording_id, 3.0 + vec_id % 3 AS spindle, CASE WHEN vec_id % 11 <> 0 THEN CAST(vec_id % 3 + 1 AS DOUBLE) END AS teeth FROM embeddings)"
_NEAR = lambda base, tol: "(" + " OR ".join(f"abs(freq - {k} * {base}) <= {tol}" for k in range(1, 5)) + ")"
_SIDE = "(" + " OR ".join(f"({k} * spindle * teeth {s} spindle > 0 AND abs(freq - ({k} * spindle * teeth {s} spindle)) <= 0.5)" for k in range(1, 5) for s in "-+") + ")"


@query(f"""WITH {INDIC}, {PSD}, {_BANDS_SQL}, {_META},
ti AS (SELECT recording_id, sqrt(avg(x * x)) AS time_rms, var_pop(x) AS time_variance, stddev_pop(x) AS time_std, max(x) - min(x) AS time_peak_to_peak, avg(abs(x)) AS time_mean_absolute, max(abs(x)) / sqrt(avg(x * x)) AS time_crest_factor,
 kurtosis(x) + 3 AS time_kurtosis, skewness(x) AS time_skewness, max(abs(x)) / avg(abs(x)) AS time_impulse_factor, sqrt(avg(x * x)) / avg(abs(x)) AS time_shape_factor, max(abs(x)) / avg(sqrt(abs(x))) ** 2 AS time_clearance_factor, avg(crossed) * 64 / 63 AS time_zero_crossing_rate
 FROM (SELECT *, CASE WHEN (x < 0) <> (lag(x) OVER (PARTITION BY recording_id ORDER BY n) < 0) THEN 1.0 ELSE 0.0 END AS crossed FROM sig) GROUP BY 1),
fr AS (SELECT recording_id, any_value(spindle) AS spindle, any_value(teeth) AS teeth, sum(p) AS total, sum(freq * p) / sum(p) AS freq_centroid, kurtosis(p * 1000) + 3 AS freq_spectral_kurtosis, arg_max(freq, p) AS peak, sum(CASE WHEN freq BETWEEN 8 AND 20 THEN p ELSE 0 END) AS ch, sum(CASE WHEN freq BETWEEN 0 AND 8 THEN p ELSE 0 END) AS lo, sum(CASE WHEN freq BETWEEN 20 AND 32 THEN p ELSE 0 END) AS hi,
 sum(CASE WHEN {_NEAR('spindle', 0.5)} THEN p ELSE 0 END) AS sp, sum(CASE WHEN {_NEAR('spindle * teeth', 0.5)} THEN p ELSE 0 END) AS te, sum(CASE WHEN {_NEAR('spindle', 0.5)} OR {_NEAR('spindle * teeth', 0.5)} THEN p ELSE 0 END) AS fo, sum(CASE WHEN {_SIDE} THEN p ELSE 0 END) AS si FROM psd JOIN md USING (recording_id) GROUP BY 1),
f2 AS (SELECT recording_id, sqrt(sum((freq - freq_centroid) ** 2 * p / total)) AS freq_spread, -sum(p / total * log2(p / total)) FILTER (WHERE p > 0) / log2(33) AS freq_entropy FROM psd JOIN fr USING (recording_id) GROUP BY 1),
lm AS (SELECT recording_id, layer, sum(q * freq) AS c, -sum(q * log2(q)) FILTER (WHERE q > 0) / log2(33) AS h FROM shm GROUP BY 1, 2), lb AS (SELECT recording_id, layer, sqrt(sum((freq - c) ** 2 * q)) AS b FROM shm JOIN lm USING (recording_id, layer) GROUP BY 1, 2),
im AS (SELECT recording_id, max(e) / sum(e) AS imf_max_energy_ratio, avg(c) AS imf_centre_freq_mean, avg(b) AS imf_bandwidth_mean, avg(h) AS imf_entropy_mean, avg(CASE WHEN nx IS NOT NULL THEN CASE WHEN nx <= c THEN 1.0 ELSE 0.0 END END) AS imf_frequency_ordering_score
 FROM (SELECT *, lead(c) OVER (PARTITION BY recording_id ORDER BY layer) AS nx FROM lm JOIN lb USING (recording_id, layer) JOIN en USING (recording_id, layer)) GROUP BY 1),
ad AS (SELECT recording_id, avg(r) AS imf_mode_mixing_index, max(r) AS imf_max_adjacent_correlation FROM (SELECT a.recording_id, a.layer, abs(corr(a.x, b.x)) AS r FROM lay a JOIN lay b ON a.recording_id = b.recording_id AND a.n = b.n AND a.layer + 1 = b.layer GROUP BY 1, 2) GROUP BY 1),
og AS (SELECT recording_id, (sum(s * s) - sum(e)) / sum(e) AS imf_orthogonality_index FROM (SELECT recording_id, n, sum(x) AS s, sum(x * x) AS e FROM allay GROUP BY 1, 2) GROUP BY 1),
gs AS (SELECT recording_id, CAST(count(*) AS DOUBLE) AS imf_count, CAST(sum(CASE WHEN g2 >= 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS imf_selected_count, max(CASE WHEN layer = 1 THEN corr END) AS imf1_correlation FROM (SELECT i.*, 1 / (1 + exp(-(4 * r_ch + 2 * corr + ks + prox - 5 * coalesce(r2, 0) - 1.5))) AS g2 FROM ind i
 JOIN (SELECT recording_id, layer, sum(CASE WHEN {_NEAR('spindle', 0.5)} OR {_NEAR('spindle * teeth', 0.5)} THEN q ELSE 0 END) AS r2 FROM shm JOIN (SELECT recording_id, CASE WHEN teeth IS NULL THEN NULL ELSE spindle END AS spindle, teeth FROM md) USING (recording_id) GROUP BY 1, 2) USING (recording_id, layer)) GROUP BY 1),
wa AS (SELECT recording_id, sum(CASE WHEN band <> 'cA2' THEN q ELSE 0 END) AS wavelet_high_freq_ratio, -sum(q * log2(q)) FILTER (WHERE q > 0) / log2(3) AS wavelet_entropy FROM (SELECT recording_id, band, energy / sum(energy) OVER (PARTITION BY recording_id) AS q FROM enw) GROUP BY 1),
al AS (SELECT *, 0 AS window_index, peak AS freq_peak, ch / total AS freq_chatter_band_ratio, CASE WHEN teeth > 0 THEN sp / total END AS freq_spindle_harmonic_ratio, CASE WHEN teeth > 0 THEN te / total END AS freq_tooth_harmonic_ratio, CASE WHEN teeth > 0 THEN te / total END AS freq_harmonics_ratio, CASE WHEN teeth > 0 THEN si / nullif(te, 0) END AS freq_sideband_ratio,
 lo / total AS freq_band_energy_ratio_below_chatter, ch / total AS freq_band_energy_ratio_chatter, hi / total AS freq_band_energy_ratio_above_chatter, ch AS physics_chatter_band_energy, exp(-0.5 * (CASE WHEN peak < 8 THEN 8 - peak WHEN peak > 20 THEN peak - 20 ELSE 0 END / 6.0) ** 2) AS physics_frequency_proximity,
 CASE WHEN teeth > 0 THEN spindle END AS physics_spindle_frequency_hz, spindle * teeth AS physics_tooth_passing_frequency_hz, CASE WHEN teeth > 0 THEN least({', '.join(f'abs(peak - {k} * spindle)' for k in range(1, 5))}) END AS physics_peak_to_spindle_harmonic_distance_hz, CASE WHEN teeth > 0 THEN least({', '.join(f'abs(peak - {k} * spindle * teeth)' for k in range(1, 5))}) END AS physics_peak_to_tooth_harmonic_distance_hz,
 CASE WHEN teeth > 0 THEN si END AS physics_sideband_strength, CASE WHEN teeth > 0 THEN fo END AS physics_forced_vibration_energy, CASE WHEN teeth > 0 THEN ch / nullif(fo, 0) END AS physics_chatter_to_harmonic_energy_ratio FROM ti JOIN fr USING (recording_id) JOIN f2 USING (recording_id) JOIN im USING (recording_id) JOIN ad USING (recording_id) JOIN og USING (recording_id) JOIN gs USING (recording_id) JOIN wa USING (recording_id))
SELECT recording_id, window_index, {', '.join(f'round({c}, 6) AS {c}' for c in STATIC)} FROM al""")
def stage4_features(spark, sf_dir):
    """The features of whole recordings over the moving-average modes, but for those of envelopes and short-time spectra."""
    layers = M.moving_average_modes(S.embedding_signal(spark, sf_dir)).groupBy("recording_id", "layer").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("z"))
    layers = layers.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("layer", F.col("z.x").alias("x")))).alias("a")).select("recording_id", F.col("a.x").alias("layers"))
    rows = _with_metadata(spark, sf_dir).join(layers, "recording_id").select("recording_id", "rpm", "tooth_count", F.col("x").alias("source"), F.col("x").alias("clean"), "layers")
    gates = S4.layer_metrics(rows, FS, BAND, 4, 0.5).select("recording_id", M.gate_array(F.col("metrics"), BAND).alias("gates"))
    made = S4.stage4_features(S4.window_rows(rows.join(gates, "recording_id"), 64, 64), FS, BAND, 4, 0.5, 0.5, "db2", 2)
    return made.select("recording_id", "window_index", *(r6(F.col(c)).alias(c) for c in STATIC))


@query(f"""WITH {MODES}, {_DFT_PAIR}, q AS (SELECT recording_id, quantile_cont(abs(x), 0.95) AS top FROM av GROUP BY 1),
t AS (SELECT recording_id, sqrt(avg(x * x)) AS rms_before, sqrt(avg(a1 * a1)) AS rms_after, sum(x * x) AS energy_before, sum(a1 * a1) AS energy_after, abs(corr(x, a1)) AS correlation, sum(CASE WHEN abs(x) >= top THEN a1 * a1 ELSE 0 END) / sum(CASE WHEN abs(x) >= top THEN x * x ELSE 0 END) AS transient_preservation FROM av JOIN q USING (recording_id) GROUP BY 1),
s AS (SELECT recording_id, sum(CASE WHEN freq BETWEEN 8 AND 20 THEN b ELSE 0 END) / sum(CASE WHEN freq BETWEEN 8 AND 20 THEN a ELSE 0 END) AS chatter_band_retention, 1 - sum(CASE WHEN freq BETWEEN 8 AND 20 THEN 0 ELSE b END) / sum(CASE WHEN freq BETWEEN 8 AND 20 THEN 0 ELSE a END) AS out_of_band_attenuation, sum(abs(qa - qb)) AS spectral_distortion
 FROM (SELECT u.recording_id, u.freq, u.p AS a, v.p AS b, u.p / sum(u.p) OVER (PARTITION BY u.recording_id) AS qa, v.p / sum(v.p) OVER (PARTITION BY u.recording_id) AS qb FROM psdu u JOIN psdv v ON u.recording_id = v.recording_id AND u.k = v.k) GROUP BY 1)
SELECT recording_id, {', '.join(f'round({c}, 6) AS {c}' for c in R.DENOISING)} FROM t JOIN s USING (recording_id)""")
def denoising_metrics(spark, sf_dir):
    """What a moving average over three samples does to each vector."""
    smooth = S.to_arrays(S.embedding_signal(spark, sf_dir).withColumn("x", F.avg("x").over(W.in_order().rowsBetween(-1, 1)))).withColumnRenamed("x", "clean")
    rows = S.embedding_arrays(spark, sf_dir).withColumnRenamed("x", "source").join(smooth, "recording_id")
    made = R.denoising_metrics(rows, FS, BAND)
    return made.select("recording_id", *(r6(F.col(c)).alias(c) for c in R.DENOISING))


@query(f"SELECT vec_id AS recording_id, c.low AS cutoff, round(0.2 * least(1, abs(CAST(embedding[1] AS DOUBLE))) + 0.15 * least(1, abs(CAST(embedding[2] AS DOUBLE))) + 0.15 * least(1, abs(CAST(embedding[3] AS DOUBLE))) + 0.15 * greatest(0, least(1, 1 - abs(CAST(embedding[4] AS DOUBLE)))) + 0.2 * least(1, abs(CAST(embedding[5] AS DOUBLE))) + 0.15 * CASE WHEN raw > 0 THEN 1 - exp(-abs(ln(greatest(new, 2.2250738585072014e-308) / raw))) WHEN new > 0 THEN 1.0 ELSE 0.0 END, 6) AS objective FROM (SELECT *, greatest(CAST(embedding[6] AS DOUBLE), 0) AS raw, greatest(CAST(embedding[7] AS DOUBLE), 0) AS new FROM embeddings), (SELECT unnest([50.0, 100.0]) AS low) c")
def objective_formula(spark, sf_dir):
    """The six-part objective as a formula, its parts read from vector components."""
    e = lambda k: F.abs(F.get(F.col("embedding"), F.lit(k - 1)).cast("double"))
    raw, new = (F.greatest(F.get(F.col("embedding"), F.lit(k - 1)).cast("double"), F.lit(0.0)) for k in (6, 7))
    parts = {"spectral_overlap": e(1), "maximum_adjacent_correlation": e(2), "absolute_orthogonality": e(3), "frequency_ordering": e(4), "seed_instability": e(5), "chatter_band_distortion": R.band_distortion(raw, new)}
    rows = S.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("recording_id"), *(v.alias(n) for n, v in parts.items()), F.explode(F.array(F.lit(50.0), F.lit(100.0))).alias("cutoff"))
    return rows.select("recording_id", "cutoff", r6(R.objective()).alias("objective"))


@query()
def output_checksums(spark, sf_dir):
    return X.digests(spark, f"{sf_dir}/*.parquet")


@query()
def stream_hysteresis(spark, sf_dir):
    """The score stream read from files, its states appended to a table in the shared folder, and that table."""
    folder = f"{shared_folder(spark)}/hysteresis-{uuid.uuid4().hex}"
    S.user_scores(spark, sf_dir).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("recording_id long, n long, p double").parquet(f"{folder}/in")
    run = hysteresis_stream(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


#: The envelope (by the analytic signal), its smoothed energy, and short-time energies of 32 samples, from sums of cosines and sines.
_EARLY_SQL = f"""{VECTORS}, ks AS (SELECT unnest(range(0, 33)) AS k), ft AS (SELECT recording_id, k, sum(x * cos(2 * pi() * k * n / 64)) AS re, -sum(x * sin(2 * pi() * k * n / 64)) AS im FROM sig, ks GROUP BY 1, 2),
an AS (SELECT recording_id, n, sum(g * (re * cos(2 * pi() * k * n / 64) - im * sin(2 * pi() * k * n / 64))) / 64 AS re, sum(g * (re * sin(2 * pi() * k * n / 64) + im * cos(2 * pi() * k * n / 64))) / 64 AS im FROM (SELECT *, CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS g FROM ft), (SELECT unnest(range(0, 64)) AS n) GROUP BY 1, 2),
ev AS (SELECT recording_id, n, sqrt(re * re + im * im) AS a, re * re + im * im AS e FROM an), sm AS (SELECT recording_id, n, sum(e) OVER (PARTITION BY recording_id ORDER BY n ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS s FROM ev),
gr AS (SELECT recording_id, n, (lead(s) OVER w - lag(s) OVER w) * 32 AS d FROM sm WINDOW w AS (PARTITION BY recording_id ORDER BY n)), hg AS (SELECT recording_id, avg(greatest(d, 0)) AS hegr FROM gr WHERE n BETWEEN 1 AND 62 GROUP BY 1),
ea AS (SELECT recording_id, avg(a) AS am, max(a) AS ax, avg(e) AS em, max(e) AS ex FROM ev GROUP BY 1), sl AS (SELECT recording_id, regr_slope(s, n / 64.0) AS g FROM sm GROUP BY 1),
st AS (SELECT recording_id, f, k, (pow(sum(v * cos(2 * pi() * k * i / 32)), 2) + pow(sum(v * sin(2 * pi() * k * i / 32)), 2)) / 256 AS e FROM (SELECT recording_id, f, n - 16 * f AS i, x * (0.5 - 0.5 * cos(2 * pi() * (n - 16 * f) / 32)) AS v FROM sig, (SELECT unnest([0, 1, 2]) AS f) WHERE n >= 16 * f AND n < 16 * f + 32), (SELECT unnest(range(0, 17)) AS k) GROUP BY 1, 2, 3),
fr AS (SELECT recording_id, f, sum(e) AS t, sum(CASE WHEN 2 * k BETWEEN 8 AND 20 THEN e ELSE 0 END) AS c, max(e) AS m, arg_max(2.0 * k, e) AS r FROM st GROUP BY 1, 2),
sh AS (SELECT recording_id, max(m) / sum(t) AS conc, median(r) AS ridge, regr_slope(c, (16 * f + 16) / 64.0) AS cg, regr_slope(t, (16 * f + 16) / 64.0) AS tg FROM fr GROUP BY 1)"""


@query(f"""WITH {_EARLY_SQL} SELECT recording_id, round(conc, 6) AS wavelet_time_frequency_concentration, CAST(ridge AS DOUBLE) AS wavelet_dominant_ridge_hz, round(am, 6) AS early_instantaneous_amplitude_mean, round(ax, 6) AS early_instantaneous_amplitude_max, round(em, 6) AS early_instantaneous_energy_mean,
 round(ex, 6) AS early_instantaneous_energy_max, round(g, 5) AS early_energy_growth_rate, round(hegr, 5) AS early_hegr, round(cg, 5) AS early_chatter_band_energy_growth, round(tg, 5) AS early_short_term_spectral_energy_growth FROM ea JOIN sl USING (recording_id) JOIN hg USING (recording_id) JOIN sh USING (recording_id)""")
def early_features(spark, sf_dir):
    """The envelope and short-time features of the vectors themselves, one window each."""
    rows = S.embedding_arrays(spark, sf_dir).select("recording_id", F.lit(0).alias("window_index"), F.col("x").alias("clean"))
    made = S4.early_features(rows, FS, BAND)
    five = {"early_energy_growth_rate", "early_hegr", "early_chatter_band_energy_growth", "early_short_term_spectral_energy_growth"}
    return made.select("recording_id", *[F.round(c, 5 if c in five else 6).alias(c) for c in S4.EARLY])
