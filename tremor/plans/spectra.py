"""Queries on spectra and modes, over the vectors read as recordings of 64 samples at 64 Hz."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tremor.functions.expressions import clip, distance_to_band, gaussian, kurtosis_pearson, near_harmonic, near_sideband, r6, ratio
from tremor.operators import modes as M
from tremor.operators import search as R
from tremor.operators import spectral as P
from tremor.plans.registry import VECTORS, query
from tremor.sources import signals as S

FS, CHATTER, SPINDLE, TOOTH, HARMONICS, TOLERANCE = 64.0, (8.0, 20.0), 3.0, 6.0, 4, 0.5

_DFT = """mu{s} AS (SELECT {k}, avg(x) AS m FROM {t} GROUP BY {k}),
tw{s} AS (SELECT {k}, n, (x - m) * (0.5 - 0.5 * cos(2 * pi() * n / 64)) AS v FROM {t} JOIN mu{s} USING ({k})),
ft{s} AS (SELECT {k}, b AS k, sum(v * cos(2 * pi() * b * n / 64)) AS re, sum(v * sin(2 * pi() * b * n / 64)) AS im FROM tw{s}, (SELECT unnest(range(0, 33)) AS b) GROUP BY {k}, b),
psd{s} AS (SELECT {k}, k, CAST(k AS DOUBLE) AS freq, (re * re + im * im) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END / (64 * 24.0) AS p FROM ft{s})"""
PSD = _DFT.format(s="", k="recording_id", t="sig")
SHARE = "sh AS (SELECT recording_id, k, freq, p, p / sum(p) OVER (PARTITION BY recording_id) AS q FROM psd)"
HARM = lambda f0: "(" + " OR ".join(f"abs(freq - {k} * {f0}) <= {TOLERANCE}" for k in range(1, HARMONICS + 1)) + ")"
SIDE = "(" + " OR ".join(f"abs(freq - {c}) <= {TOLERANCE}" for k in range(1, HARMONICS + 1) for c in (k * TOOTH - SPINDLE, k * TOOTH + SPINDLE) if c > 0) + ")"


def spectrum(spark, sf_dir):
    return P.psd(S.embedding_arrays(spark, sf_dir), FS, 64)


def _r(df, *keys):
    return df.select(*keys, *[r6(F.col(c)).alias(c) for c in df.columns if c not in keys])


@query(f"WITH {VECTORS}, {PSD}, {SHARE} SELECT recording_id, CAST(k AS INTEGER) AS k, freq, round(q, 6) AS p FROM sh")
def welch_psd(spark, sf_dir):
    return P.unit_mass(spectrum(spark, sf_dir), ["recording_id"]).select("recording_id", F.col("k").cast("int").alias("k"), "freq", r6(F.col("p")).alias("p"))


@query(f"""WITH {VECTORS}, {PSD}, {SHARE}, c AS (SELECT recording_id, sum(freq * q) AS c FROM sh GROUP BY 1)
SELECT recording_id, round(max(c), 6) AS centroid, round(sqrt(sum((freq - c) ** 2 * q)), 6) AS spread, round(-sum(q * log2(q)) FILTER (WHERE q > 0) / log2(33), 6) AS entropy FROM sh JOIN c USING (recording_id) GROUP BY 1""")
def spectral_summary(spark, sf_dir):
    return _r(P.summary(spectrum(spark, sf_dir), ["recording_id"]).select("recording_id", "centroid", "spread", "entropy"), "recording_id")


@query(f"WITH {VECTORS}, {PSD}, r AS (SELECT recording_id, freq, row_number() OVER (PARTITION BY recording_id ORDER BY p DESC, freq) AS i FROM psd) SELECT recording_id, freq AS peak_hz, round(exp(-0.5 * (CASE WHEN freq < 8 THEN 8 - freq WHEN freq > 20 THEN freq - 20 ELSE 0 END / 3.0) ** 2), 6) AS proximity FROM r WHERE i = 1")
def peak_frequency(spark, sf_dir):
    s = P.summary(spectrum(spark, sf_dir), ["recording_id"])
    return s.select("recording_id", F.col("peak").alias("peak_hz"), r6(gaussian(distance_to_band(F.col("peak"), *CHATTER), 0.0, 3.0)).alias("proximity"))


@query(f"WITH {VECTORS}, {PSD}, {SHARE} SELECT recording_id, round(kurtosis(p * 1000) + 3, 6) AS spectral_kurtosis FROM sh GROUP BY 1")
def spectral_kurtosis(spark, sf_dir):
    return spectrum(spark, sf_dir).groupBy("recording_id").agg(r6(kurtosis_pearson(F.col("p") * 1000)).alias("spectral_kurtosis"))


@query(f"""WITH {VECTORS}, {PSD}, {SHARE} SELECT recording_id, round(sum(CASE WHEN freq BETWEEN 0 AND 8 THEN q ELSE 0 END), 6) AS low, round(sum(CASE WHEN freq BETWEEN 8 AND 20 THEN q ELSE 0 END), 6) AS chatter,
 round(sum(CASE WHEN freq BETWEEN 20 AND 32 THEN q ELSE 0 END), 6) AS high FROM sh GROUP BY 1""")
def band_energy_ratios(spark, sf_dir):
    f = F.col("freq")
    return spectrum(spark, sf_dir).groupBy("recording_id").agg(*[r6(P.band_ratio(f.between(a, b))).alias(n) for n, a, b in (("low", 0, 8), ("chatter", *CHATTER), ("high", 20, 32))])


@query(f"""WITH {VECTORS}, {PSD}, {SHARE} SELECT recording_id, round(sum(CASE WHEN {HARM(SPINDLE)} THEN q ELSE 0 END), 6) AS spindle_ratio, round(sum(CASE WHEN {HARM(TOOTH)} THEN q ELSE 0 END), 6) AS tooth_ratio,
 round(sum(CASE WHEN {HARM(SPINDLE)} OR {HARM(TOOTH)} THEN q ELSE 0 END), 6) AS forced_ratio, round(sum(CASE WHEN {SIDE} THEN q ELSE 0 END) / nullif(sum(CASE WHEN {HARM(TOOTH)} THEN q ELSE 0 END), 0), 6) AS sideband_ratio FROM sh GROUP BY 1""")
def harmonic_ratios(spark, sf_dir):
    f = F.col("freq")
    spindle, tooth = near_harmonic(f, F.lit(SPINDLE), HARMONICS, TOLERANCE), near_harmonic(f, F.lit(TOOTH), HARMONICS, TOLERANCE)
    side = near_sideband(f, F.lit(TOOTH), F.lit(SPINDLE), HARMONICS, TOLERANCE)
    made = spectrum(spark, sf_dir).groupBy("recording_id").agg(P.band_ratio(spindle).alias("spindle_ratio"), P.band_ratio(tooth).alias("tooth_ratio"), P.band_ratio(spindle | tooth).alias("forced_ratio"), P.band_ratio(side).alias("__side"))
    return _r(made.withColumn("sideband_ratio", ratio(F.col("__side"), F.col("tooth_ratio"))).drop("__side"), "recording_id")


@query(f"""WITH {VECTORS}, {PSD}, r AS (SELECT recording_id, freq, row_number() OVER (PARTITION BY recording_id ORDER BY p DESC, freq) AS i FROM psd)
SELECT recording_id, least({', '.join(f'abs(freq - {k * SPINDLE})' for k in range(1, 5))}) AS spindle_distance_hz, least({', '.join(f'abs(freq - {k * TOOTH})' for k in range(1, 5))}) AS tooth_distance_hz FROM r WHERE i = 1""")
def peak_harmonic_distance(spark, sf_dir):
    s = P.summary(spectrum(spark, sf_dir), ["recording_id"])
    near = lambda f0: F.array_min(F.transform(F.sequence(F.lit(1), F.lit(HARMONICS)), lambda k: F.abs(F.col("peak") - k * f0)))
    return s.select("recording_id", near(SPINDLE).alias("spindle_distance_hz"), near(TOOTH).alias("tooth_distance_hz"))


MODES = f"""{VECTORS}, av AS (SELECT recording_id, n, x, avg(x) OVER (PARTITION BY recording_id ORDER BY n ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS a1,
 avg(x) OVER (PARTITION BY recording_id ORDER BY n ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS a2, avg(x) OVER (PARTITION BY recording_id ORDER BY n ROWS BETWEEN 13 PRECEDING AND 13 FOLLOWING) AS a3 FROM sig),
lay AS (SELECT recording_id, 1 AS layer, n, x - a1 AS x FROM av UNION ALL SELECT recording_id, 2, n, a1 - a2 FROM av UNION ALL SELECT recording_id, 3, n, a2 - a3 FROM av),
allay AS (SELECT * FROM lay UNION ALL SELECT recording_id, 4, n, a3 FROM av)"""
MPSD = _DFT.format(s="m", k="recording_id, layer", t="lay")
MSHARE = "shm AS (SELECT recording_id, layer, k, freq, p, p / sum(p) OVER (PARTITION BY recording_id, layer) AS q FROM psdm)"
MCENTRE = "cen AS (SELECT recording_id, layer, sum(freq * q) AS c FROM shm GROUP BY 1, 2)"
METRICS = f"""{MODES}, {MPSD}, {MSHARE}, {MCENTRE}, en AS (SELECT recording_id, layer, sum(x * x) AS e, sqrt(avg(x * x)) AS rms FROM lay GROUP BY 1, 2)"""
INDIC = f"""{METRICS}, ba AS (SELECT recording_id, layer, sum(CASE WHEN freq BETWEEN 8 AND 20 THEN q ELSE 0 END) AS r_ch, sum(CASE WHEN {HARM(SPINDLE)} THEN q ELSE 0 END) AS r_f FROM shm GROUP BY 1, 2),
mo AS (SELECT l.recording_id, layer, abs(covar_pop(l.x, s.x) / (stddev_pop(l.x) * stddev_pop(s.x))) AS corr, kurtosis(l.x) + 3 AS kurt, least(greatest((kurtosis(l.x) + 3 - 3) / 10.0, 0), 1) AS ks, sum(l.x * l.x) AS energy FROM lay l JOIN sig s ON l.recording_id = s.recording_id AND l.n = s.n GROUP BY 1, 2),
dom AS (SELECT recording_id, layer, freq AS peak FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, layer ORDER BY p DESC, freq) AS i FROM psdm) WHERE i = 1),
ind AS (SELECT ba.recording_id, ba.layer, r_ch, r_f, c, corr, kurt, ks, energy, exp(-0.5 * ((c - 14) / 6.0) ** 2) AS prox, exp(-((peak - 14) ** 2) / (2 * 6.0 ** 2)) AS dprox FROM ba JOIN mo USING (recording_id, layer) JOIN cen USING (recording_id, layer) JOIN dom USING (recording_id, layer)),
gt AS (SELECT *, 1 / (1 + exp(-(4 * r_ch + 2 * corr + ks + prox - 5 * r_f - 1.5))) AS gate FROM ind)"""
WEIGHTS = """ws AS (SELECT *, 0.25 * (corr / sum(corr) OVER r + energy / sum(energy) OVER r + kurt / sum(kurt) OVER r + CASE WHEN sum(dprox) OVER r > 0 THEN dprox / sum(dprox) OVER r ELSE 1.0 / 3 END) AS w FROM gt WINDOW r AS (PARTITION BY recording_id)),
wt AS (SELECT *, w / sum(w) OVER (PARTITION BY recording_id) AS weight FROM ws)"""


def modes_of(spark, sf_dir):
    return M.moving_average_modes(S.embedding_signal(spark, sf_dir))


def indicators_of(spark, sf_dir):
    modes = modes_of(spark, sf_dir)
    return M.indicators(S.embedding_signal(spark, sf_dir), modes, M.mode_psd(modes, FS, 64), CHATTER, SPINDLE, HARMONICS, TOLERANCE)


@query(f"""WITH {METRICS} SELECT recording_id, layer, round(max(100 * e / tot), 6) AS energy_percentage, round(max(rms), 6) AS rms, round(max(c), 6) AS centre_hz, round(sqrt(sum((freq - c) ** 2 * q)), 6) AS bandwidth_hz,
 round(-sum(q * log2(q)) FILTER (WHERE q > 0) / log2(33), 6) AS spectral_entropy FROM shm JOIN cen USING (recording_id, layer) JOIN (SELECT *, sum(e) OVER (PARTITION BY recording_id) AS tot FROM en) USING (recording_id, layer) GROUP BY 1, 2""")
def imf_metrics(spark, sf_dir):
    modes = modes_of(spark, sf_dir)
    return _r(M.mode_metrics(modes, M.mode_psd(modes, FS, 64)), "recording_id", "layer")


@query(f"WITH {MODES} SELECT a.recording_id, a.layer, round(abs(covar_pop(a.x, b.x) / (stddev_pop(a.x) * stddev_pop(b.x))), 6) AS correlation FROM lay a JOIN lay b ON a.recording_id = b.recording_id AND a.n = b.n AND a.layer + 1 = b.layer GROUP BY 1, 2")
def adjacent_correlation(spark, sf_dir):
    return _r(M.adjacent_correlation(modes_of(spark, sf_dir)), "recording_id", "layer")


@query(f"WITH {MODES} SELECT a.recording_id, a.layer AS i, b.layer AS j, round(abs(covar_pop(a.x, b.x) / (stddev_pop(a.x) * stddev_pop(b.x))), 6) AS correlation FROM lay a JOIN lay b ON a.recording_id = b.recording_id AND a.n = b.n AND a.layer <= b.layer GROUP BY 1, 2, 3")
def imf_correlation_matrix(spark, sf_dir):
    return _r(M.correlation_matrix(modes_of(spark, sf_dir)), "recording_id", "i", "j")


@query(f"WITH {MODES}, c AS (SELECT a.recording_id, a.layer, abs(covar_pop(a.x, b.x) / (stddev_pop(a.x) * stddev_pop(b.x))) AS r FROM lay a JOIN lay b ON a.recording_id = b.recording_id AND a.n = b.n AND a.layer + 1 = b.layer GROUP BY 1, 2) SELECT recording_id, round(avg(r), 6) AS mode_mixing, round(max(r), 6) AS strongest FROM c GROUP BY 1")
def mode_mixing_index(spark, sf_dir):
    return M.adjacent_correlation(modes_of(spark, sf_dir)).groupBy("recording_id").agg(r6(F.avg("correlation")).alias("mode_mixing"), r6(F.max("correlation")).alias("strongest"))


@query(f"""WITH {MODES}, e AS (SELECT recording_id, sum(x * x) AS e FROM allay GROUP BY 1), p AS (SELECT a.recording_id, sum(a.x * b.x) AS s FROM allay a JOIN allay b ON a.recording_id = b.recording_id AND a.n = b.n AND a.layer < b.layer GROUP BY 1)
SELECT recording_id, round(2 * s / e, 6) AS orthogonality FROM e JOIN p USING (recording_id)""")
def orthogonality(spark, sf_dir):
    return _r(M.orthogonality(modes_of(spark, sf_dir)), "recording_id")


@query(f"WITH {METRICS}, o AS (SELECT recording_id, c, lead(c) OVER (PARTITION BY recording_id ORDER BY layer) AS nx FROM cen) SELECT recording_id, round(coalesce(avg(CASE WHEN nx IS NOT NULL THEN CASE WHEN c >= nx THEN 1.0 ELSE 0.0 END END), 1), 6) AS ordering FROM o GROUP BY 1")
def frequency_ordering(spark, sf_dir):
    modes = modes_of(spark, sf_dir)
    return _r(M.frequency_ordering(M.mode_metrics(modes, M.mode_psd(modes, FS, 64))), "recording_id")


@query(f"WITH {METRICS} SELECT a.recording_id, a.layer, round(least(1, sum(least(a.q, b.q))), 6) AS overlap FROM shm a JOIN shm b ON a.recording_id = b.recording_id AND a.k = b.k AND a.layer + 1 = b.layer GROUP BY 1, 2")
def spectral_overlap(spark, sf_dir):
    return _r(P.overlap(M.mode_psd(modes_of(spark, sf_dir), FS, 64), "recording_id", "layer"), "recording_id", "layer")


@query(f"WITH {MODES} SELECT s.recording_id, round(sqrt(avg((s.x - t) ** 2)) / sqrt(avg(s.x * s.x)), 6) AS nrmse FROM sig s JOIN (SELECT recording_id, n, sum(x) AS t FROM allay GROUP BY 1, 2) USING (recording_id, n) GROUP BY 1")
def reconstruction_nrmse(spark, sf_dir):
    return _r(M.reconstruction_error(S.embedding_signal(spark, sf_dir), modes_of(spark, sf_dir)), "recording_id")


@query(f"WITH {INDIC} SELECT recording_id, layer, round(r_ch, 6) AS chatter_ratio, round(r_f, 6) AS forced_ratio, round(corr, 6) AS correlation, round(ks, 6) AS kurtosis_score, round(prox, 6) AS proximity, round(gate, 6) AS gate, gate >= 0.5 AS selected FROM gt")
def physics_gates(spark, sf_dir):
    g = M.gates(indicators_of(spark, sf_dir))
    return g.select("recording_id", "layer", *[r6(F.col(c)).alias(c) for c in ("chatter_ratio", "forced_ratio", "correlation", "kurtosis_score", "proximity", "gate")], (F.col("gate") >= 0.5).alias("selected"))


@query(f"WITH {INDIC}, {WEIGHTS} SELECT recording_id, layer, round(weight, 6) AS weight FROM wt")
def indicator_weights(spark, sf_dir):
    return M.indicator_weights(indicators_of(spark, sf_dir)).select("recording_id", "layer", r6(F.col("weight")).alias("weight"))


@query(f"WITH {INDIC} SELECT recording_id, n, round(sum(gate * x), 6) AS x FROM lay JOIN gt USING (recording_id, layer) GROUP BY 1, 2")
def gated_reconstruction(spark, sf_dir):
    return _r(M.reconstruct(modes_of(spark, sf_dir), M.gates(indicators_of(spark, sf_dir)), "gate"), "recording_id", "n")


@query(f"WITH {INDIC}, {WEIGHTS} SELECT recording_id, n, round(sum(weight * x), 6) AS x FROM lay JOIN wt USING (recording_id, layer) GROUP BY 1, 2")
def weighted_reconstruction(spark, sf_dir):
    return _r(M.reconstruct(modes_of(spark, sf_dir), M.indicator_weights(indicators_of(spark, sf_dir)), "weight"), "recording_id", "n")


@query(f"""WITH {INDIC}, rec AS (SELECT recording_id, n, sum(gate * x) AS x FROM lay JOIN gt USING (recording_id, layer) GROUP BY 1, 2), {PSD}, {_DFT.format(s='r', k='recording_id', t='rec')},
j AS (SELECT psd.recording_id, psd.freq, psd.p AS a, psdr.p AS b, psd.p / sum(psd.p) OVER (PARTITION BY psd.recording_id) AS qa, psdr.p / sum(psdr.p) OVER (PARTITION BY psd.recording_id) AS qb FROM psd JOIN psdr ON psd.recording_id = psdr.recording_id AND psd.k = psdr.k)
SELECT recording_id, round(sum(CASE WHEN freq BETWEEN 8 AND 20 THEN b ELSE 0 END) / sum(CASE WHEN freq BETWEEN 8 AND 20 THEN a ELSE 0 END), 6) AS chatter_retention,
 round(1 - sum(CASE WHEN freq BETWEEN 8 AND 20 THEN 0 ELSE b END) / sum(CASE WHEN freq BETWEEN 8 AND 20 THEN 0 ELSE a END), 6) AS out_of_band_attenuation, round(sum(abs(qa - qb)), 6) AS spectral_distortion FROM j GROUP BY 1""")
def before_after_metrics(spark, sf_dir):
    made = M.reconstruct(modes_of(spark, sf_dir), M.gates(indicators_of(spark, sf_dir)), "gate")
    return _r(M.compare_spectra(spectrum(spark, sf_dir), P.psd(S.to_arrays(made), FS, 64), CHATTER), "recording_id")


@query(f"""WITH {VECTORS}, g AS (SELECT e.label AS recording_id, s.n + 1 AS layer, 1 / (1 + exp(-10 * s.x)) AS gate FROM sig s JOIN embeddings e ON e.vec_id = s.recording_id)
SELECT recording_id, CAST(layer AS BIGINT) AS layer, round(avg(gate), 6) AS mean_gate, round(stddev_pop(gate), 6) AS std_gate, CAST(sum(CASE WHEN gate >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS selected, count(DISTINCT gate >= 0.5) = 1 AS unanimous FROM g GROUP BY 1, 2""")
def gate_stability(spark, sf_dir):
    e = S.read(spark, sf_dir, "embeddings").select(F.col("label").alias("recording_id"), F.posexplode("embedding").alias("layer", "v"))
    g = e.select("recording_id", (F.col("layer") + 1).cast("long").alias("layer"), (1 / (1 + F.exp(-10 * F.col("v").cast("double")))).alias("gate"))
    return M.gate_stability(g, 0.5).select("recording_id", "layer", r6(F.col("mean_gate")).alias("mean_gate"), r6(F.col("std_gate")).alias("std_gate"), "selected", "unanimous")


_OBJ = f"""{INDIC}, ob AS (SELECT recording_id, layer, 0.4 * least(greatest(1 - r_ch, 0), 1) + 0.3 * least(greatest(1 - corr, 0), 1) + 0.2 * least(greatest(r_f, 0), 1) + 0.1 * least(greatest(1 - prox, 0), 1) AS objective FROM gt)"""


def objectives(spark, sf_dir):
    parts = ((0.4, 1 - F.col("chatter_ratio")), (0.3, 1 - F.col("correlation")), (0.2, F.col("forced_ratio")), (0.1, 1 - F.col("proximity")))
    return indicators_of(spark, sf_dir).select("recording_id", "layer", sum((w * clip(c, 0.0, 1.0) for w, c in parts), F.lit(0.0)).alias("objective"))


@query(f"WITH {_OBJ} SELECT recording_id, layer, round(objective, 6) AS objective FROM ob")
def cutoff_objective(spark, sf_dir):
    return _r(objectives(spark, sf_dir), "recording_id", "layer")


@query(f"""WITH {_OBJ}, r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY objective, layer) AS i, lead(objective) OVER (PARTITION BY recording_id ORDER BY objective, layer) AS nx FROM ob)
SELECT recording_id, layer AS best, round(objective, 6) AS objective, round(nx - objective, 6) AS gap FROM r WHERE i = 1""")
def topk_cutoff(spark, sf_dir):
    w = Window.partitionBy("recording_id").orderBy("objective", "layer")
    r = objectives(spark, sf_dir).withColumn("__i", F.row_number().over(w)).withColumn("__next", F.lead("objective").over(w)).filter("__i = 1")
    return r.select("recording_id", F.col("layer").alias("best"), r6(F.col("objective")).alias("objective"), r6(F.col("__next") - F.col("objective")).alias("gap"))


@query(f"""WITH {MODES}, e AS (SELECT recording_id, sum(x * x) AS e FROM allay GROUP BY 1), p AS (SELECT a.recording_id, a.layer, b.layer AS other, sum(a.x * b.x) AS s FROM allay a JOIN allay b ON a.recording_id = b.recording_id AND a.n = b.n AND a.layer < b.layer GROUP BY 1, 2, 3)
SELECT recording_id, round(2 * sum(s) / any_value(e), 6) AS signed, round(abs(2 * sum(s) / any_value(e)), 6) AS absolute, round(2 * sum(abs(s)) / any_value(e), 6) AS pairwise_absolute FROM e JOIN p USING (recording_id) GROUP BY 1""")
def orthogonality_forms(spark, sf_dir):
    return _r(M.orthogonality_forms(modes_of(spark, sf_dir)), "recording_id")


@query(f"""WITH {INDIC}, rec AS (SELECT recording_id, n, sum(gate * x) AS x FROM lay JOIN gt USING (recording_id, layer) GROUP BY 1, 2), {PSD}, {_DFT.format(s='r', k='recording_id', t='rec')},
j AS (SELECT psd.recording_id, psd.freq, psd.p AS a, psdr.p AS b, psd.p / sum(psd.p) OVER (PARTITION BY psd.recording_id) AS qa, psdr.p / sum(psdr.p) OVER (PARTITION BY psd.recording_id) AS qb FROM psd JOIN psdr ON psd.recording_id = psdr.recording_id AND psd.k = psdr.k),
f AS (SELECT recording_id, sum(b) FILTER (WHERE freq BETWEEN 8 AND 20) / sum(a) FILTER (WHERE freq BETWEEN 8 AND 20) AS c, 1 - sum(b) FILTER (WHERE {HARM(SPINDLE)}) / sum(a) FILTER (WHERE {HARM(SPINDLE)}) AS sp, 1 - sum(b) FILTER (WHERE {HARM(TOOTH)}) / sum(a) FILTER (WHERE {HARM(TOOTH)}) AS te,
 1 - sum(b) FILTER (WHERE freq NOT BETWEEN 8 AND 20) / sum(a) FILTER (WHERE freq NOT BETWEEN 8 AND 20) AS o, sum(abs(qa - qb)) AS d FROM j GROUP BY 1),
t AS (SELECT recording_id, sqrt(avg(s.x * s.x)) AS rb, sqrt(avg(r.x * r.x)) AS ra, sum(s.x * s.x) AS eb, sum(r.x * r.x) AS ea, covar_pop(s.x, r.x) / nullif(stddev_pop(s.x) * stddev_pop(r.x), 0) AS co FROM sig s JOIN rec r USING (recording_id, n) GROUP BY 1)
SELECT recording_id, round(rb, 6) AS rms_before, round(ra, 6) AS rms_after, round(eb, 6) AS energy_before, round(ea, 6) AS energy_after, round(coalesce(co, 0), 6) AS correlation, round(c, 6) AS chatter_band_retention, round(sp, 6) AS spindle_harmonic_attenuation,
 round(te, 6) AS tooth_harmonic_attenuation, round(o, 6) AS out_of_band_attenuation, round(d, 6) AS spectral_distortion FROM f JOIN t USING (recording_id)""")
def weighting_metrics(spark, sf_dir):
    made = S.to_arrays(M.reconstruct(modes_of(spark, sf_dir), M.gates(indicators_of(spark, sf_dir)), "gate")).withColumnRenamed("x", "clean")
    rows = S.embedding_arrays(spark, sf_dir).withColumnRenamed("x", "source").join(made, "recording_id")
    return _r(R.weighting_metrics(rows, FS, CHATTER, SPINDLE, TOOTH, HARMONICS, TOLERANCE), "recording_id")


@query(f"""WITH {VECTORS}, w3 AS (SELECT recording_id, n, avg(x) OVER (PARTITION BY recording_id ORDER BY n ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS x FROM sig), w9 AS (SELECT recording_id, n, avg(x) OVER (PARTITION BY recording_id ORDER BY n ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS x FROM sig),
{PSD}, {_DFT.format(s='a', k='recording_id', t='w3')}, {_DFT.format(s='b', k='recording_id', t='w9')},
e AS (SELECT recording_id, s, sum((p + nx) / 2) AS e FROM (SELECT recording_id, s, k, p, lead(p) OVER (PARTITION BY recording_id, s ORDER BY k) AS nx FROM (SELECT recording_id, 0 AS s, k, p FROM psd UNION ALL SELECT recording_id, 1, k, p FROM psda UNION ALL SELECT recording_id, 2, k, p FROM psdb) WHERE k BETWEEN 8 AND 20) GROUP BY 1, 2)
SELECT a.recording_id, round(b.e / a.e, 6) AS smoothed, round(c.e / a.e, 6) AS smoother FROM e a JOIN e b ON a.recording_id = b.recording_id AND b.s = 1 JOIN e c ON a.recording_id = c.recording_id AND c.s = 2 WHERE a.s = 0""")
def cumulative_retention(spark, sf_dir):
    """What moving averages over 3 and 9 samples leave of the band."""
    rows = S.embedding_signal(spark, sf_dir)
    w = Window.partitionBy("recording_id").orderBy("n")
    wide = rows.select("recording_id", "n", "x", F.avg("x").over(w.rowsBetween(-1, 1)).alias("a"), F.avg("x").over(w.rowsBetween(-4, 4)).alias("b"))
    pairs = F.array_sort(F.collect_list(F.struct("n", "x", "a", "b")))
    arrays = wide.groupBy("recording_id").agg(pairs.alias("s")).select("recording_id", "s.x", "s.a", "s.b")
    made = R.cumulative_retention(arrays, ["x", "a", "b"], FS, CHATTER)
    return made.select("recording_id", r6(F.col("retention")[1]).alias("smoothed"), r6(F.col("retention")[2]).alias("smoother"))


@query(f"""WITH {MODES}, e AS (SELECT recording_id, sum(x * x) AS e FROM allay GROUP BY 1), p AS (SELECT a.recording_id, sum(a.x * b.x) AS s FROM allay a JOIN allay b ON a.recording_id = b.recording_id AND a.n = b.n AND a.layer < b.layer GROUP BY 1),
c AS (SELECT a.recording_id, a.layer, abs(covar_pop(a.x, b.x) / (stddev_pop(a.x) * stddev_pop(b.x))) AS r FROM allay a JOIN allay b ON a.recording_id = b.recording_id AND a.n = b.n AND a.layer + 1 = b.layer GROUP BY 1, 2), mm AS (SELECT recording_id, avg(r) AS mm FROM c GROUP BY 1),
sp AS (SELECT recording_id, layer, k, sqrt(pow(sum(x * cos(2 * pi() * k * n / 64)), 2) + pow(sum(x * sin(2 * pi() * k * n / 64)), 2)) AS m FROM allay, (SELECT unnest(range(0, 32)) AS k) GROUP BY 1, 2, 3),
mf AS (SELECT recording_id, layer, sum(k * m) / sum(m) AS f FROM sp GROUP BY 1, 2), o AS (SELECT recording_id, (1 - corr(layer, f)) / 2 AS o FROM mf GROUP BY 1), f1 AS (SELECT recording_id, 100 * sum(x * x) AS first FROM allay WHERE layer = 1 GROUP BY 1)
SELECT recording_id, round(2 * s / e, 6) AS orthogonality_index, round(mm, 6) AS mode_mixing_index, round(o, 6) AS frequency_ordering_index, round(first / e, 5) AS first_percent FROM e JOIN p USING (recording_id) JOIN mm USING (recording_id) JOIN o USING (recording_id) JOIN f1 USING (recording_id)""")
def decomposition_validation(spark, sf_dir):
    made = M.decomposition_validation(modes_of(spark, sf_dir), FS)
    return made.select("recording_id", *[r6(F.col(c)).alias(c) for c in ("orthogonality_index", "mode_mixing_index", "frequency_ordering_index")], F.round(F.col("energy_percent")[0], 5).alias("first_percent"))


@query(f"""WITH {METRICS}, ov AS (SELECT a.recording_id, a.layer, least(1, sum(least(a.q, b.q))) AS o FROM shm a JOIN shm b ON a.recording_id = b.recording_id AND a.k = b.k AND a.layer + 1 = b.layer GROUP BY 1, 2), oa AS (SELECT recording_id, avg(o) AS o FROM ov GROUP BY 1),
c AS (SELECT a.recording_id, a.layer, abs(covar_pop(a.x, b.x) / (stddev_pop(a.x) * stddev_pop(b.x))) AS r FROM lay a JOIN lay b ON a.recording_id = b.recording_id AND a.n = b.n AND a.layer + 1 = b.layer GROUP BY 1, 2), ca AS (SELECT recording_id, max(r) AS r FROM c GROUP BY 1),
e AS (SELECT recording_id, sum(x * x) AS e FROM allay GROUP BY 1), p AS (SELECT a.recording_id, sum(a.x * b.x) AS s FROM allay a JOIN allay b ON a.recording_id = b.recording_id AND a.n = b.n AND a.layer < b.layer GROUP BY 1)
SELECT recording_id, round(0.35 * o + 0.35 * r + 0.3 * abs(2 * s / e), 6) AS score FROM oa JOIN ca USING (recording_id) JOIN e USING (recording_id) JOIN p USING (recording_id)""".replace("en AS (SELECT recording_id, layer, sum(x * x) AS e", "enn AS (SELECT recording_id, layer, sum(x * x) AS e"))
def composite_score(spark, sf_dir):
    modes = modes_of(spark, sf_dir)
    overlaps = P.overlap(M.mode_psd(modes, FS, 64), "recording_id", "layer")
    return _r(R.composite_score(overlaps, M.adjacent_correlation(modes), M.orthogonality(modes)), "recording_id")
