"""Decompositions on the grid (recording x cutoff x seed): the cutoff objective, stability over seeds, and denoising quality.

A cell is one row of arrays and is worked on where it lies; only the few cells of one (recording, cutoff) are brought together.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.functions import kernels as K
from tremor.functions.expressions import clip
from tremor.operators import spectral as P
from tremor.operators import stage4
from tremor.operators.spectral import map_arrays, map_many
from tremor.operators.tables import keep

_D, _DS = T.DoubleType(), T.ArrayType(T.DoubleType())
#: The weights of the objective's six parts.
OBJECTIVE = {
    "spectral_overlap": 0.20, "maximum_adjacent_correlation": 0.15, "absolute_orthogonality": 0.15, "frequency_ordering_penalty": 0.15, "seed_instability": 0.20, "chatter_band_distortion": 0.15,
}
PARTS = ("centre_frequency", "energy_distribution", "matched_correlation_loss", "spectral_overlap_variation", "imf_count_variation")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by key: a kernel's work per row outweighs moving a small array, and input files may be few and small."""
    context = rows.sparkSession.sparkContext
    return rows.repartition(max(2 * context.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def decompose(rows: DataFrame, keys: list[str], trials: int = 300, sifts: int = 16, epsilon: float = 0.02, max_modes: int = -1, seed: str | None = None) -> DataFrame:
    """rows (keys, source, ..) with layers: the ensemble modes of source, residual last. seed: a column, else 42 for all."""
    kept = [c for c in rows.columns if c != "source"]
    number = F.col(seed).cast("double") if seed else F.lit(42.0)
    packed = spread(rows.select(*kept, "source", F.concat(F.array(number), "source").alias("x")), *keys)

    def kernel(values):
        alike: dict = {}
        for i, v in enumerate(values):
            alike.setdefault((len(v), int(v[0])), []).append(i)
        layers: list = [None] * len(values)
        for (_, number), rows in alike.items():  # rows of one length and seed share noise, so their trials are sifted together
            for i, modes in zip(rows, K.ensembles(np.stack([values[i][1:] for i in rows]), trials, epsilon, number, sifts, max_modes), strict=True):
                layers[i] = (modes,)
        return layers

    return map_many(packed, kernel, [T.StructField("layers", T.ArrayType(_DS))])


def objective_weights(configured: dict[str, float] | None = None) -> dict[str, float]:
    """Weights of the parts, summing to 1; those not configured keep their default."""
    weights = {k: float((configured or {}).get(k, v)) for k, v in OBJECTIVE.items()}
    if min(weights.values()) < 0 or not 0 < sum(weights.values()) < float("inf"):
        raise ValueError("weights must be finite and not negative, and one of them positive")
    return {k: v / sum(weights.values()) for k, v in weights.items()}


def objective(weights: dict[str, float] | None = None):
    """The objective of a row with the six parts as columns (ordering as frequency_ordering), each bounded to 0 .. 1; lower is better."""
    parts = {k: F.col(k) for k in OBJECTIVE} | {"frequency_ordering_penalty": 1 - F.col("frequency_ordering")}
    return sum((w * clip(parts[k], 0.0, 1.0) for k, w in objective_weights(weights).items()), F.lit(0.0))


def band_distortion(raw, filtered):
    """How far a band's energy changed, up or down: 1 - exp(-|log ratio|), 0 where it was and is 0, 1 where it came from nothing."""
    tiny = F.lit(2.2250738585072014e-308)
    changed = clip(1 - F.exp(-F.abs(F.ln(F.greatest(filtered, tiny) / F.nullif(raw, F.lit(0.0))))), 0.0, 1.0)
    return F.when(raw <= tiny, F.when(filtered <= tiny, 0.0).otherwise(1.0)).otherwise(changed)


def band_energy(arrays: DataFrame, column: str, name: str, fs: float, band: tuple[float, float], nperseg: int = 1024) -> DataFrame:
    """arrays with the sum of the Welch density of a column in a band."""
    def kernel(x):
        freq = np.fft.rfftfreq(min(len(x), nperseg), 1 / fs)
        return (float(P.welch(x, fs, nperseg)[(freq >= band[0]) & (freq <= band[1])].sum()),)

    return map_arrays(arrays.withColumn("__x", F.col(column)), kernel, [T.StructField(name, _D)], "__x")


def cell_metrics(cells: DataFrame, fs: float, chatter: tuple[float, float], nperseg: int = 1024) -> DataFrame:
    """cells (keys, source, layers) without arrays, with metrics per mode and the parts of the objective that a cell has on its own."""
    plain = cells.withColumns({c: F.lit(None).cast("double") for c in ("rpm", "tooth_count") if c not in cells.columns})
    m = stage4.layer_metrics(plain, fs, chatter, 5, 15.0, nperseg)
    centre = F.transform("metrics", lambda x: x["centre_hz"])
    return m.withColumns({
        "maximum_adjacent_correlation": F.coalesce("adjacent_max", F.lit(0.0)), "absolute_orthogonality": F.abs(F.coalesce("orthogonality", F.lit(0.0))),
        "frequency_ordering": F.coalesce(stage4.falling_share(centre), F.lit(1.0)), "imf_count": F.size("metrics"),
    }).drop("adjacent_max", "adjacent_mean", "rpm", "tooth_count")


def _seed_sets(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x): all cells of keys in one array, by seed: their number, counts of modes, then centres, energies, gates and samples of the modes. cells has metrics, layers and gates."""
    part = lambda n: F.flatten(F.transform("__all", lambda c: F.transform(c["metrics"], lambda m: m[n])))
    modes = F.flatten(F.transform("__all", lambda c: F.flatten(F.slice(c["layers"], F.lit(1), F.size(c["metrics"])))))
    one = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seed", "metrics", "layers", "gates"))).alias("__all"))
    counts = F.transform("__all", lambda c: F.size(c["metrics"]).cast("double"))
    return one.select(*keys, F.concat(F.array(F.size("__all").cast("double")), counts, part("centre_hz"), part("energy"), F.flatten(F.transform("__all", lambda c: c["gates"])), modes).alias("x"))


def _unpacked(v: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Of each seed: centres, energy shares, gates, modes."""
    n = int(v[0])
    counts = v[1 : n + 1].astype(int)
    k = int(counts.sum())
    at = 1 + n
    blocks = [v[at + i * k : at + (i + 1) * k] for i in range(3)]
    modes = v[at + 3 * k :].reshape(k, -1) if k else np.empty((0, 0))
    cuts = np.cumsum(counts)[:-1]
    out = []
    for centre, energy, gate, x in zip(*(np.split(b, cuts) for b in (*blocks, modes)), strict=True):
        out.append((centre, energy / energy.sum() if energy.sum() > 0 else energy, gate, x))
    return out


def matched(a: tuple, b: tuple, fs: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A least-cost matching of two seeds' modes (0.65 of one less the correlation, 0.35 of the distance of centres): rows, columns, correlations and log ratios of centres."""
    x, y = (m - m.mean(1, keepdims=True) for m in (a[3], b[3]))
    size = np.sqrt((x * x).sum(1)[:, None] * (y * y).sum(1)[None])
    r = np.divide(np.abs(x @ y.T), size, out=np.zeros_like(size), where=size > 2.2250738585072014e-308)
    eps = max(fs * 1e-12, 2.220446049250313e-16)
    gap = np.abs(np.log((a[0][:, None] + eps) / (b[0][None] + eps)))
    pairs = K.assign(0.65 * (1 - r) + 0.35 * (1 - np.exp(-gap)))
    i, j = (np.array([p[k] for p in pairs], dtype=int) for k in (0, 1))
    return i, j, r[i, j], gap[i, j]


def seed_stability(cells: DataFrame, keys: list[str], fs: float, overlaps: DataFrame) -> DataFrame:
    """The five parts of the structural instability over all pairs of seeds, their mean, and the mean and least matched correlation.

    overlaps: (keys, spectral_overlap) of each cell. Without a second seed nothing varies.
    """

    def kernel(v):
        seeds = _unpacked(v)
        rows = []
        for a, b in itertools.combinations(seeds, 2):
            p, q = len(a[0]), len(b[0])
            if not p or not q:
                rows.append((1.0, 0.5 * float(a[1].sum() + b[1].sum()), 0.0, 0.0, 1.0 if p != q else 0.0))
                continue
            i, j, r, gap = matched(a, b, fs)
            rest = a[1].sum() - a[1][i].sum() + b[1].sum() - b[1][j].sum()
            energy = min(1.0, 0.5 * float(np.abs(a[1][i] - b[1][j]).sum() + rest))
            rows.append((float(1 - np.exp(-gap.mean())), energy, float(r.mean()), float(r.min()), abs(p - q) / max(p, q)))
        if not rows:
            return 0.0, 0.0, 0.0, 0.0, 1.0, len(seeds)
        m = np.array(rows)
        return float(m[:, 0].mean()), float(m[:, 1].mean()), float(1 - m[:, 2].mean()), float(m[:, 4].mean()), float(m[:, 3].min()), len(seeds)

    names = [PARTS[0], PARTS[1], PARTS[2], PARTS[4], "least_matched_correlation"]
    made = map_arrays(_seed_sets(cells, keys), kernel, [*(T.StructField(n, _D) for n in names), T.StructField("seeds", T.IntegerType())])
    varied = overlaps.groupBy(*keys).agg(F.least(F.lit(1.0), F.stddev_pop("spectral_overlap")).alias(PARTS[3]))
    both = made.join(varied, keys)
    return both.withColumn("seed_instability", sum((F.col(p) for p in PARTS), F.lit(0.0)) / len(PARTS))


def matched_gate_stability(cells: DataFrame, keys: list[str], fs: float, threshold: float = 0.5, least: float = 0.5) -> DataFrame:
    """Gates over seeds after matching each seed's modes to the first seed's; pairs correlated under `least` count as unmatched.

    One row for each mode of the first seed: mean_gate and std_gate over the seeds that have it, selected_fraction over all; and
    of the whole recording selected_consistency and unmatched_penalty.
    """
    fields = [T.StructField(n, _DS) for n in ("mean_gate", "std_gate", "selected_fraction")] + [T.StructField(n, _D) for n in ("selected_consistency", "unmatched_penalty")]

    def kernel(v):
        seeds = _unpacked(v)
        own = seeds[0]
        n = len(own[0])
        if not n:
            return [], [], [], None, None
        gates = np.full((len(seeds), n), np.nan)
        gates[0] = own[2]
        for k, other in enumerate(seeds[1:], 1):
            if len(other[0]):
                i, j, r, _ = matched(own, other, fs)
                gates[k, i[r >= least]] = other[2][j[r >= least]]
        chosen = gates >= threshold
        return np.nanmean(gates, axis=0), np.nanstd(gates, axis=0), chosen.mean(0), float((chosen == chosen[0]).all(0).mean()), float(np.isnan(gates).mean())

    made = map_arrays(_seed_sets(cells, keys), kernel, fields)
    zipped = F.arrays_zip("mean_gate", "std_gate", "selected_fraction")
    return made.select(*keys, F.posexplode(zipped).alias("layer", "z"), "selected_consistency", "unmatched_penalty").select(*keys, (F.col("layer") + 1).alias("layer"), "z.*", "selected_consistency", "unmatched_penalty")


def cutoff_grid(
    arrays: DataFrame, cutoffs: list[float], seeds: list[int], high: float, fs: float, chatter: tuple[float, float], order: int = 3, trials: int = 15, sifts: int = 16, nperseg: int = 1024, weights: dict[str, float] | None = None
) -> DataFrame:
    """One row per (recording, cutoff): the six parts (means over seeds), the objective, the objectives by seed, and the place among the recording's cutoffs.

    arrays: (recording_id, x). Also gap_to_second, the next best objective less this one's at place 1, and seed_consistency, the share of
    seeds whose own best cutoff is the chosen one (NULL with one seed). Ties go to the first cutoff given.
    """
    if not cutoffs or not seeds or len(set(seeds)) != len(seeds):
        raise ValueError("cutoffs and unlike seeds are needed")
    grid = F.array(*(F.struct(F.lit(k).alias("rank"), F.lit(float(c)).alias("cutoff")) for k, c in enumerate(cutoffs)))
    tries = arrays.select("recording_id", F.explode(grid).alias("g"), "x").select("recording_id", "g.rank", "g.cutoff", F.col("x").alias("raw"), F.concat(F.array("g.cutoff"), "x").alias("x"))
    filtered = map_arrays(spread(tries, "recording_id", "cutoff"), lambda v: (K.detrend(K.bandpass(v[1:], float(v[0]), high, fs, order)),), [T.StructField("source", _DS)])
    rated = keep(band_energy(band_energy(filtered, "raw", "before", fs, chatter, nperseg), "source", "after", fs, chatter, nperseg).drop("raw"), "filtered")
    keys = ["recording_id", "cutoff"]
    cells = keep(decompose(rated.select(*keys, "source", F.explode(F.array(*map(F.lit, seeds))).alias("seed")), [*keys, "seed"], trials, sifts, seed="seed"), "cells")
    metrics = keep(cell_metrics(cells, fs, chatter, nperseg), "metrics")
    packed = cells.select(*keys, "seed", "layers").join(metrics.select(*keys, "seed", "metrics"), [*keys, "seed"]).withColumn("gates", F.transform("metrics", lambda m: F.lit(0.0)))
    stability = keep(seed_stability(packed, keys, fs, metrics), "stability")
    shared = rated.select(*keys, "rank", band_distortion(F.col("before"), F.col("after")).alias("chatter_band_distortion")).join(stability, keys)
    own = ("spectral_overlap", "maximum_adjacent_correlation", "absolute_orthogonality", "frequency_ordering")
    by_seed = metrics.select(*keys, "seed", *own).join(shared, keys).withColumn("__o", objective(weights))
    best = by_seed.groupBy("recording_id", "seed").agg(F.min_by("cutoff", F.struct("__o", "rank")).alias("cutoff")).groupBy("recording_id", "cutoff").agg(F.count("*").alias("__votes"))
    mean = by_seed.groupBy(*keys, "rank", "seeds", "chatter_band_distortion", "seed_instability").agg(*(F.avg(c).alias(c) for c in own), F.map_from_entries(F.array_sort(F.collect_list(F.struct("seed", "__o")))).alias("objective_by_seed"))
    scored = mean.withColumn("objective", objective(weights)).join(best, keys, "left")
    w = Window.partitionBy("recording_id").orderBy("objective", "rank")
    placed = scored.withColumns({"place": F.row_number().over(w), "gap_to_second": F.coalesce(F.lead("objective").over(w) - F.col("objective"), F.lit(0.0))})
    return placed.withColumn("seed_consistency", F.when(F.col("seeds") > 1, F.coalesce("__votes", F.lit(0)) / F.col("seeds"))).drop("rank", "__votes")


DENOISING = ("rms_before", "rms_after", "energy_before", "energy_after", "correlation", "chatter_band_retention", "out_of_band_attenuation", "spectral_distortion", "transient_preservation")


def denoising_metrics(rows: DataFrame, fs: float, chatter: tuple[float, float], nperseg: int = 1024) -> DataFrame:
    """rows (keys, source, clean) without the arrays, with nine measures of what denoising did; transients are the top 5 % of magnitudes."""

    def kernel(v):
        a, b = v.reshape(2, -1)
        freq = np.fft.rfftfreq(min(len(a), nperseg), 1 / fs)
        p, q = P.welch(a, fs, nperseg), P.welch(b, fs, nperseg)
        inside = (freq >= chatter[0]) & (freq <= chatter[1])
        kept = lambda m: float(q[m].sum() / p[m].sum()) if p[m].sum() > 0 else 0.0
        both = p.sum() > 0 and q.sum() > 0
        top = np.abs(a) >= np.quantile(np.abs(a), 0.95)
        energy = a @ a, b @ b
        moved = stage4.correlation_of(a - a.mean(), b - b.mean())
        burst = float((a[top] ** 2).sum())
        return (
            *(float(np.sqrt(e / len(a))) for e in energy), *map(float, energy), moved if moved is not None else 0.0, kept(inside), 1 - kept(~inside),
            float(np.abs(p / p.sum() - q / q.sum()).sum()) if both else 0.0, float((b[top] ** 2).sum()) / burst if burst > 0 else 0.0,
        )

    kept = [c for c in rows.columns if c not in ("source", "clean")]
    return map_arrays(rows.select(*kept, F.concat("source", "clean").alias("x")), kernel, [T.StructField(n, _D) for n in DENOISING])


def composite_score(overlaps: DataFrame, neighbours: DataFrame, orthogonality: DataFrame) -> DataFrame:
    """(recording_id, score), lower is better: 0.35 mean overlap + 0.35 largest correlation of neighbours + 0.3 |orthogonality| (fixed values); a single mode has neither of the first two."""
    a = overlaps.groupBy("recording_id").agg(F.avg("overlap").alias("__a"))
    b = neighbours.groupBy("recording_id").agg(F.max("correlation").alias("__b"))
    zero = F.lit(0.0)
    score = 0.35 * F.coalesce("__a", zero) + 0.35 * F.coalesce("__b", zero) + 0.30 * F.coalesce(F.abs("orthogonality"), zero)
    return orthogonality.join(a, "recording_id", "left").join(b, "recording_id", "left").select("recording_id", score.alias("score"))


WEIGHTING = ("rms_before", "rms_after", "energy_before", "energy_after", "correlation", "chatter_band_retention", "spindle_harmonic_attenuation", "tooth_harmonic_attenuation", "out_of_band_attenuation", "spectral_distortion")


def weighting_metrics(rows: DataFrame, fs: float, chatter: tuple[float, float], spindle: float, tooth: float, harmonics: int, tolerance: float, nperseg: int = 1024) -> DataFrame:
    """rows (keys, source, clean) without the arrays, with the ten measures of what weighting did; a band without power before keeps 0 of it."""

    def kernel(v):
        a, b = v.reshape(2, -1)
        freq = np.fft.rfftfreq(min(len(a), nperseg), 1 / fs)
        p, q = P.welch(a, fs, nperseg), P.welch(b, fs, nperseg)
        kept = lambda m: float(q[m].sum() / p[m].sum()) if p[m].sum() > 0 else 0.0
        near = lambda f: (np.abs(freq[:, None] - f * np.arange(1, harmonics + 1)) <= tolerance).any(1)
        inside = (freq >= chatter[0]) & (freq <= chatter[1])
        energy = float(a @ a), float(b @ b)
        moved = stage4.correlation_of(a - a.mean(), b - b.mean())
        apart = float(np.abs(p / p.sum() - q / q.sum()).sum()) if p.sum() > 0 and q.sum() > 0 else 0.0
        return (*(float(np.sqrt(e / len(a))) for e in energy), *energy, moved if moved is not None else 0.0, kept(inside), 1 - kept(near(spindle)), 1 - kept(near(tooth)), 1 - kept(~inside), apart)

    kept = [c for c in rows.columns if c not in ("source", "clean")]
    return map_arrays(rows.select(*kept, F.concat("source", "clean").alias("x")), kernel, [T.StructField(n, _D) for n in WEIGHTING])


def cumulative_retention(rows: DataFrame, stages: list[str], fs: float, chatter: tuple[float, float], nperseg: int = 1024) -> DataFrame:
    """rows without the arrays in the columns stages, with retention: the power of the band (trapezoids over its bins) at each stage over that of the first, whose own is 1.

    Where the first stage has no power in the band the others' powers stand as they are.
    """

    def kernel(v):
        freq = None
        powers = []
        for x in v.reshape(len(stages), -1):
            freq = np.fft.rfftfreq(min(len(x), nperseg), 1 / fs)
            inside = (freq >= chatter[0]) & (freq <= chatter[1])
            p, f = P.welch(x, fs, nperseg)[inside], freq[inside]
            powers.append(float(((p[1:] + p[:-1]) / 2 * np.diff(f)).sum()))
        first = powers[0] if powers[0] > 0 else 1.0
        return ([1.0, *(p / first for p in powers[1:])],)

    kept = [c for c in rows.columns if c not in stages]
    return map_arrays(rows.select(*kept, F.concat(*stages).alias("x")), kernel, [T.StructField("retention", _DS)])


QUALITY = ("rmse", "snr_db", "spectral_distortion", "chatter_band_retention", "noise_band_attenuation", "onset_detection_error")


def quality_of(reference: np.ndarray, clean: np.ndarray, fs: float, chatter: tuple[float, float], onset_s: float | None) -> tuple:
    """QUALITY of a denoised signal against the known one, after the gain that fits best; a ratio without a rest is infinite, an onset that is not found (or not known) gives None.

    Spectra are magnitudes over their sum, below half the rate; the onset is where the smoothed distance from the mean first crosses half its range. Fixed values:
    1e-12 beside a spectrum's sum, 50 samples of smoothing.
    """
    energy = float(clean @ clean)
    b = clean * (float(reference @ clean) / energy) if energy > 0 else clean
    rest, power = float(np.var(reference - b)), float(np.var(reference))
    with np.errstate(divide="ignore"):
        snr = 10 * float(np.log10(power / rest)) if rest > 0 else float("inf")
    freq = np.arange((len(b) + 1) // 2) * fs / len(b)
    p, q = (m / (m.sum() + 1e-12) for m in (np.abs(np.fft.rfft(v))[: len(freq)] for v in (reference, b)))
    inside = (freq >= chatter[0]) & (freq <= chatter[1])
    share = lambda m: float(q[m].sum() / p[m].sum()) if p[m].sum() > 0 else None
    kept, left = share(inside), share(~inside)
    e = np.abs(b - b.mean())
    e = np.convolve(e, np.full(50, 1 / 50), mode="same") if len(e) > 50 else e
    turns = np.flatnonzero(np.diff(e > (e.min() + e.max()) / 2))
    late = abs(float(turns[0]) / fs - onset_s) if len(turns) and onset_s is not None else None
    return float(np.sqrt(np.mean((reference - b) ** 2))), snr, float(np.abs(p - q).sum()), 0.0 if kept is None else kept, 0.0 if left is None else 1 - left, late


def reference_quality(rows: DataFrame, fs: float, chatter: tuple[float, float], onset_s: float | None = None) -> DataFrame:
    """rows (keys, reference, clean) without the arrays, with QUALITY; of arrays of unlike length the shorter one's samples count."""
    kept = [c for c in rows.columns if c not in ("reference", "clean")]
    n = F.least(F.size("reference"), F.size("clean"))
    packed = rows.select(*kept, F.concat(F.slice("reference", F.lit(1), n), F.slice("clean", F.lit(1), n)).alias("x"))
    return map_arrays(packed, lambda v: quality_of(*v.reshape(2, -1), fs, chatter, onset_s), [T.StructField(c, _D) for c in QUALITY])


def wavelet_choices(rows: DataFrame, candidates: list[tuple[str, int]], fs: float, chatter: tuple[float, float], mode: str = "soft") -> DataFrame:
    """(recording_id, wavelet, level, QUALITY, place): every candidate's quality on rows (recording_id, x, reference), place 1 the highest ratio of signal to rest."""
    if not candidates:
        raise ValueError("a candidate is needed")
    tried = F.explode(F.array(*(F.struct(F.lit(k).alias("rank"), F.lit(w).alias("wavelet"), F.lit(j).alias("level")) for k, (w, j) in enumerate(candidates))))
    cells = rows.select("recording_id", "reference", tried.alias("c"), "x").select("recording_id", "reference", "c.*", F.concat(F.array(F.col("c.rank").cast("double")), "x").alias("x"))
    cleaned = map_arrays(cells, lambda v: (K.wavelet_denoise(v[1:], *candidates[int(v[0])], fs, chatter, mode=mode),), [T.StructField("clean", _DS)])
    place = F.row_number().over(Window.partitionBy("recording_id").orderBy(F.desc("snr_db"), "rank"))
    return reference_quality(cleaned, fs, chatter).withColumn("place", place).drop("rank")
