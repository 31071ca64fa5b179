"""Queries on windows and the time domain."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremor.functions.expressions import r6
from tremor.operators import validation as V
from tremor.operators import windows as W
from tremor.plans.registry import EVENTS, METADATA, SCORES, SIGNAL, query
from tremor.sources import signals as S

_WINDOWS = """sizes AS (SELECT recording_id, count(*) AS total FROM sig GROUP BY 1),
wins AS (SELECT recording_id, unnest(range(0, (total - 100) // 50 + 1)) AS window_index FROM sizes WHERE total >= 100),
rows_ AS (SELECT sig.recording_id, window_index, n, x FROM wins JOIN sig ON sig.recording_id = wins.recording_id AND n >= window_index * 50 AND n < window_index * 50 + 100)"""

FEATURES_SQL = f"""WITH {SIGNAL}, {_WINDOWS},
z AS (SELECT *, lag(x < 0) OVER (PARTITION BY recording_id, window_index ORDER BY n) AS before FROM rows_)
SELECT recording_id, CAST(window_index AS BIGINT) AS window_index, round(sqrt(avg(x * x)), 6) AS time_rms, round(var_pop(x), 6) AS time_variance, round(stddev_pop(x), 6) AS time_std,
 round(max(x) - min(x), 6) AS time_peak_to_peak, round(avg(abs(x)), 6) AS time_mean_absolute, round(max(abs(x)) / sqrt(avg(x * x)), 6) AS time_crest_factor,
 round(kurtosis(x) + 3, 6) AS time_kurtosis, round(skewness(x), 6) AS time_skewness, round(max(abs(x)) / avg(abs(x)), 6) AS time_impulse_factor,
 round(sqrt(avg(x * x)) / avg(abs(x)), 6) AS time_shape_factor, round(max(abs(x)) / pow(avg(sqrt(abs(x))), 2), 6) AS time_clearance_factor,
 round(sum(CASE WHEN (x < 0) <> before THEN 1.0 ELSE 0.0 END) / (count(*) - 1), 6) AS time_zero_crossing_rate
FROM z GROUP BY 1, 2"""


def features_of(spark, sf_dir):
    made = W.time_features(W.sliding_windows(S.supplier_signal(spark, sf_dir), 100, 50))
    return made.select("recording_id", "window_index", *[r6(F.col(c)).alias(c) for c in made.columns if c.startswith("time_")])


@query(FEATURES_SQL)
def window_time_features(spark, sf_dir):
    return features_of(spark, sf_dir)


@query(f"WITH {SIGNAL}, {_WINDOWS} SELECT recording_id, CAST(window_index AS BIGINT) AS window_index, CAST(window_index * 50 AS BIGINT) AS start_index, CAST(window_index * 50 + 100 AS BIGINT) AS end_index, window_index * 50 / 100.0 AS start_s, (window_index * 50 + 100) / 100.0 AS end_s FROM wins")
def sliding_window_bounds(spark, sf_dir):
    return W.window_bounds(S.supplier_signal(spark, sf_dir), 100, 50, 100.0)


@query(f"""WITH {SIGNAL}, sizes AS (SELECT recording_id, count(*) AS total FROM sig GROUP BY 1),
w AS (SELECT recording_id, total, unnest(range(0, CASE WHEN total >= 255 THEN (total - 255) // 127 + 1 ELSE 1 END)) AS k FROM sizes)
SELECT recording_id, CAST(k AS BIGINT) AS window_index, CAST(k * 127 AS BIGINT) AS start_index, CAST(least(k * 127 + 255, total) AS BIGINT) AS end_index FROM w""")
def truncated_windows(spark, sf_dir):
    return W.whole_or_sliding(S.supplier_signal(spark, sf_dir), 2.559, 0.5, 100.0)


@query(f"""WITH {SIGNAL}, sizes AS (SELECT recording_id, count(*) AS total FROM sig GROUP BY 1),
w AS (SELECT recording_id, total, unnest(range(0, CASE WHEN total <= 200 THEN 1 ELSE 5 END)) AS k FROM sizes)
SELECT recording_id, CAST(k AS BIGINT) AS window_index, CAST(CASE WHEN total <= 200 THEN 0 ELSE floor(k * (total - 200) / 4.0) END AS BIGINT) AS start_index,
 CAST(least(CASE WHEN total <= 200 THEN 0 ELSE floor(k * (total - 200) / 4.0) END + 200, total) AS BIGINT) AS end_index FROM w""")
def evenly_spaced_windows(spark, sf_dir):
    return W.even_windows(S.supplier_signal(spark, sf_dir), 5, 200)


@query(f"""WITH {SIGNAL}, e AS (SELECT recording_id, n, round(sum(x * x) OVER (PARTITION BY recording_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 127 FOLLOWING), 9) AS energy, count(*) OVER (PARTITION BY recording_id) AS total FROM sig),
r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY energy DESC, n) AS k FROM e WHERE n <= total - 128 OR (total <= 128 AND n = 0))
SELECT recording_id, n AS start_index, CAST(least(n + 128, total) AS BIGINT) AS end_index, round(energy, 6) AS energy FROM r WHERE k = 1""")
def rolling_energy_segment(spark, sf_dir):
    return W.max_energy_segment(S.supplier_signal(spark, sf_dir), 128).withColumn("energy", r6(F.col("energy")))


@query(f"WITH {SIGNAL} SELECT recording_id, n, round(sum(x) OVER (PARTITION BY recording_id ORDER BY n ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10, 6) AS smoothed FROM sig")
def centered_moving_average(spark, sf_dir):
    return W.moving_average(S.supplier_signal(spark, sf_dir), 10).select("recording_id", "n", r6(F.col("smoothed")).alias("smoothed"))


@query(f"""WITH {SIGNAL}, z AS (SELECT recording_id, x < 0 AS neg, lag(x < 0) OVER (PARTITION BY recording_id ORDER BY n) AS before FROM sig)
SELECT recording_id, round(sum(CASE WHEN neg <> before THEN 1.0 ELSE 0.0 END) / (count(*) - 1), 6) AS zero_crossing_rate FROM z GROUP BY 1""")
def zero_crossing_rate(spark, sf_dir):
    whole = S.supplier_signal(spark, sf_dir).withColumn("window_index", F.lit(0))
    return W.time_features(whole).select("recording_id", r6(F.col("time_zero_crossing_rate")).alias("zero_crossing_rate"))


@query(f"""WITH {SIGNAL}, g AS (SELECT recording_id, n, x, lag(x) OVER w AS b, lead(x) OVER w AS a FROM sig WINDOW w AS (PARTITION BY recording_id ORDER BY n))
SELECT recording_id, n, round(CASE WHEN b IS NULL THEN (a - x) / 0.01 WHEN a IS NULL THEN (x - b) / 0.01 ELSE (a - b) / 0.02 END, 6) AS gradient FROM g""")
def signal_gradient(spark, sf_dir):
    return W.gradient(S.supplier_signal(spark, sf_dir), 0.01).select("recording_id", "n", r6(F.col("gradient")).alias("gradient"))


@query(f"""WITH {SIGNAL}, l AS (SELECT recording_id, regr_slope(x, n) AS b, regr_intercept(x, n) AS a FROM sig GROUP BY 1)
SELECT recording_id, n, round(x - (a + b * n), 6) AS detrended FROM sig JOIN l USING (recording_id)""")
def detrend_linear(spark, sf_dir):
    return W.detrend_linear(S.supplier_signal(spark, sf_dir)).select("recording_id", "n", r6(F.col("detrended")).alias("detrended"))


@query(f"""WITH {SIGNAL}, f AS (SELECT recording_id, quantile_cont(abs(x), 0.995) AS f FROM sig GROUP BY 1)
SELECT recording_id, n, round(x / f, 6) AS scaled, round(x / f * f, 6) AS restored, round(f, 6) AS scale_factor FROM sig JOIN f USING (recording_id)""")
def robust_scale(spark, sf_dir):
    s = S.scaled(S.supplier_signal(spark, sf_dir))
    return s.select("recording_id", "n", r6(F.col("scaled")).alias("scaled"), r6(F.col("scaled") * F.col("scale_factor")).alias("restored"), r6(F.col("scale_factor")).alias("scale_factor"))


_MEDIAN_SQL = """m AS (SELECT recording_id, n, p, lag(p, 1, p) OVER w AS b, lead(p, 1, p) OVER w AS a FROM sig WINDOW w AS (PARTITION BY recording_id ORDER BY n)),
sm AS (SELECT recording_id, n, p + a + b - greatest(p, a, b) - least(p, a, b) AS raw, list_sort([b, p, a])[2] AS smoothed FROM m)"""
_STATE_SQL = """marks AS (SELECT *, CASE WHEN smoothed >= 0.75 THEN 1 WHEN smoothed < 0.4 THEN 0 END AS mark FROM sm),
st AS (SELECT recording_id, n, smoothed, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY n ROWS UNBOUNDED PRECEDING), 0) AS state FROM marks)"""
_RUN_SQL = """ch AS (SELECT *, CASE WHEN state <> coalesce(lag(state) OVER (PARTITION BY recording_id ORDER BY n), -1) THEN 1 ELSE 0 END AS new FROM st),
ru AS (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY n) AS run FROM ch),
lab AS (SELECT recording_id, n, CASE WHEN state = 1 AND count(*) OVER (PARTITION BY recording_id, run) >= 3 THEN 1 ELSE 0 END AS label FROM ru)"""


@query(f"WITH {SCORES}, {_MEDIAN_SQL} SELECT recording_id, n, round(smoothed, 6) AS smoothed FROM sm")
def running_median(spark, sf_dir):
    return W.running_median(S.user_scores(spark, sf_dir), 3).select("recording_id", "n", r6(F.col("smoothed")).alias("smoothed"))


@query(f"WITH {SCORES}, {_MEDIAN_SQL}, {_STATE_SQL} SELECT recording_id, n, CAST(state AS INTEGER) AS state FROM st")
def hysteresis_labels(spark, sf_dir):
    return W.hysteresis(W.running_median(S.user_scores(spark, sf_dir), 3), 0.75, 0.40).select("recording_id", "n", "state")


@query(f"WITH {SCORES}, {_MEDIAN_SQL}, {_STATE_SQL}, {_RUN_SQL} SELECT recording_id, n, CAST(label AS INTEGER) AS label FROM lab")
def smoothed_labels(spark, sf_dir):
    return W.smooth_labels(S.user_scores(spark, sf_dir)).select("recording_id", "n", "label")


@query(f"""WITH {SCORES}, st AS (SELECT recording_id, n, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS state FROM sig), {_RUN_SQL} SELECT recording_id, n, CAST(label AS INTEGER) AS label FROM lab""")
def min_run_length(spark, sf_dir):
    state = S.user_scores(spark, sf_dir).withColumn("state", (F.col("p") >= 0.5).cast("int"))
    return W.minimum_run(state, 3).select("recording_id", "n", "label")


@query(f"""WITH {SIGNAL}, d AS (SELECT recording_id, n, abs(x - avg(x) OVER (PARTITION BY recording_id)) AS d FROM sig),
s AS (SELECT recording_id, n, sum(d) OVER (PARTITION BY recording_id ORDER BY n ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING) / 50 AS t, count(*) OVER (PARTITION BY recording_id) AS size, d FROM d),
s2 AS (SELECT recording_id, n, CASE WHEN size > 50 THEN t ELSE d END AS s FROM s),
o AS (SELECT recording_id, n, s > (min(s) OVER (PARTITION BY recording_id) + max(s) OVER (PARTITION BY recording_id)) / 2 AS up FROM s2),
c AS (SELECT recording_id, n, up <> lead(up) OVER (PARTITION BY recording_id ORDER BY n) AS turned FROM o)
SELECT recording_id, min(CASE WHEN turned THEN n END) AS onset_index FROM c GROUP BY 1""")
def onset_detection(spark, sf_dir):
    return W.onset(S.supplier_signal(spark, sf_dir))


@query(f"""WITH {SIGNAL}, t AS (SELECT recording_id, n, x, sin(2 * pi() * 12.5 * (n / 100.0)) / (1 + exp(-20.0 * (n / 100.0 - 2.0))) AS tone FROM sig)
SELECT recording_id, n, round(x + sqrt(var_pop(x) OVER (PARTITION BY recording_id) / (var_pop(tone) OVER (PARTITION BY recording_id) * 10)) * tone, 6) AS mixed FROM t""")
def semisynthetic_injection(spark, sf_dir):
    return W.semisynthetic(S.supplier_signal(spark, sf_dir), 100.0, 12.5, 2.0, 10.0).select("recording_id", "n", r6(F.col("mixed")).alias("mixed"))


_TIMING = """st AS (SELECT recording_id, n, t, x, t - lag(t) OVER (PARTITION BY recording_id ORDER BY n) AS dt FROM sig),
md AS (SELECT recording_id, median(dt) AS m FROM st GROUP BY 1),
tm AS (SELECT recording_id, count(*) AS samples, max(m) AS median_dt, min(dt) AS least_dt, max(abs(dt - m)) / nullif(max(m), 0) AS jitter, 1 / nullif(max(m), 0) AS rate, max(abs(x)) AS largest, stddev_pop(x) AS deviation, sum(CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 1 ELSE 0 END) AS bad FROM st JOIN md USING (recording_id) GROUP BY 1)"""


@query(f"WITH {EVENTS}, {_TIMING} SELECT recording_id, samples, round(median_dt, 3) AS median_dt, round(jitter, 4) AS jitter FROM tm")
def timestamp_jitter(spark, sf_dir):
    return V.timing(S.event_signal(spark, sf_dir)).select("recording_id", "samples", F.round("median_dt", 3).alias("median_dt"), F.round("jitter", 4).alias("jitter"))


@query(f"WITH {SIGNAL}, {_TIMING} SELECT recording_id, round(rate, 6) AS rate, abs(rate - 100) / 100 <= 0.01 AS within_tolerance FROM tm")
def sampling_rate_check(spark, sf_dir):
    return V.timing(S.supplier_signal(spark, sf_dir)).select("recording_id", r6(F.col("rate")).alias("rate"), (F.abs(F.col("rate") - 100) / 100 <= 0.01).alias("within_tolerance"))


_RULES = """concat_ws(',', CASE WHEN samples * median_dt < 1 - 1e-6 THEN 'duration' END, CASE WHEN bad > 0 THEN 'finite' END, CASE WHEN deviation <= 2.220446049250313e-16 * largest THEN 'flat' END,
 CASE WHEN jitter > 0.05 THEN 'jitter' END, CASE WHEN rate NOT BETWEEN 1e-3 AND 1e7 THEN 'rate_bounds' END, CASE WHEN abs(rate - {fs}) / {fs} > 0.01 THEN 'rate_mismatch' END,
 CASE WHEN samples < 3 THEN 'samples' END, CASE WHEN least_dt <= 0 THEN 'time_order' END)"""


@query(f"WITH {EVENTS}, {_TIMING}, v AS (SELECT recording_id, samples, {_RULES.format(fs='0.01')} AS violations FROM tm) SELECT recording_id, samples, violations, CASE WHEN violations = '' THEN 'valid' ELSE 'invalid' END AS status FROM v")
def validate_recordings(spark, sf_dir):
    return V.validate(S.event_signal(spark, sf_dir), 0.01).select("recording_id", "samples", "violations", "status")


@query(f"WITH {SIGNAL}, {_TIMING}, v AS (SELECT {_RULES.format(fs='100.0')} AS violations FROM tm) SELECT CASE WHEN violations = '' THEN 'valid' ELSE 'invalid' END AS status, count(*) AS recordings FROM v GROUP BY 1")
def validation_report(spark, sf_dir):
    return V.validate(S.supplier_signal(spark, sf_dir), 100.0).groupBy("status").agg(F.count("*").alias("recordings"))


@query(f"""WITH {METADATA} SELECT recording_id, CASE WHEN rpm IS NULL THEN 'rpm is missing' WHEN rpm <= 0 THEN 'rpm is not positive' WHEN tooth_count IS NULL THEN 'tooth count is missing' END AS reason,
 CASE WHEN tooth_count IS NOT NULL THEN round(rpm / 60, 6) END AS spindle_hz, CASE WHEN tooth_count IS NOT NULL THEN round(rpm / 60 * tooth_count, 6) END AS tooth_hz FROM meta""")
def physics_metadata_check(spark, sf_dir):
    reason = V.physics_reason(F.col("rpm"), F.col("tooth_count"))
    ok = F.col("reason").isNull()
    m = S.machining_metadata(spark, sf_dir).withColumn("reason", reason)
    return m.select("recording_id", "reason", F.when(ok, r6(F.col("rpm") / 60)).alias("spindle_hz"), F.when(ok, r6(F.col("rpm") / 60 * F.col("tooth_count"))).alias("tooth_hz"))


@query("SELECT l_orderkey AS recording_id, count(*) AS copies FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return V.duplicate_ids(S.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("recording_id")), "recording_id")
