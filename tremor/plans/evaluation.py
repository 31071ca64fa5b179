"""Queries on the dataset index and on evaluation: folds, intervals, rank tests, temporal smoothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremor.functions import expressions as E
from tremor.functions.expressions import r6
from tremor.operators import aggregates as A
from tremor.operators import dataset_index as X
from tremor.operators import detection as D
from tremor.operators import folds as L
from tremor.operators import windows as W
from tremor.operators.tables import keep
from tremor.plans.registry import METADATA, query
from tremor.plans.time_domain import FEATURES_SQL, features_of
from tremor.sources import signals as S

# --- dataset index: orders are recordings, parts the rows of a workbook --------------------------------------------------

_ORDERS = """files AS (SELECT CASE o_custkey % 4 WHEN 0 THEN '2inch' WHEN 1 THEN '2p5inch' WHEN 2 THEN '3p5inch' ELSE '4p5inch' END || CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE '_stickout' END || '/' || ['c','i','s','u'][o_orderkey % 4 + 1] || '_' || (o_custkey % 40 * 10 + 300) || '_' ||
  CASE WHEN o_orderkey % 97 = 0 THEN 'x' ELSE lpad(CAST(o_orderkey % 60 AS VARCHAR), 3, '0') END || '_' || (o_orderkey // 7) || '.mat' AS path FROM orders)"""
_PARTS = """meta AS (SELECT p_partkey AS ord, [2.0, 2.5, 3.5, 4.5][p_size % 4 + 1] + CASE WHEN p_partkey % 3 = 0 THEN 0.04 ELSE 0 END AS stickout, CAST(p_partkey % 40 * 10 + 300 AS DOUBLE) AS rpm,
  CAST(p_size + p_partkey % 7 AS DOUBLE) / 1000 + CASE WHEN p_partkey % 2 = 0 THEN 0.0004 ELSE 0 END AS depth_of_cut, 0.002 + p_partkey % 5 * 0.001 AS feed_rate, CASE p_partkey % 3 WHEN 0 THEN 'stable' WHEN 1 THEN 'incipient' ELSE 'chatter' END AS label FROM part)"""


def order_paths(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    folder = F.concat(F.get(F.array(*[F.lit(x) for x in ("2inch", "2p5inch", "3p5inch", "4p5inch")]), (c % 4).cast("int")), F.when(o % 50 == 0, "").otherwise("_stickout"))
    depth = F.when(o % 97 == 0, "x").otherwise(F.lpad((o % 60).cast("string"), 3, "0"))
    name = F.concat_ws("_", F.get(F.array(*[F.lit(x) for x in "cisu"]), (o % 4).cast("int")), (c % 40 * 10 + 300).cast("string"), depth, F.floor(o / 7).cast("string"))
    return S.read(spark, sf_dir, "orders").select(F.concat(folder, F.lit("/"), name, F.lit(".mat")).alias("path"))


def part_conditions(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    stick = F.get(F.array(*[F.lit(x) for x in (2.0, 2.5, 3.5, 4.5)]), (s % 4).cast("int")) + F.when(k % 3 == 0, 0.04).otherwise(0.0)
    depth = (s + k % 7).cast("double") / 1000 + F.when(k % 2 == 0, 0.0004).otherwise(0.0)
    label = F.get(F.array(*[F.lit(x) for x in ("stable", "incipient", "chatter")]), (k % 3).cast("int"))
    return S.read(spark, sf_dir, "part").select(k.cast("long").alias("ord"), stick.alias("stickout"), (k % 40 * 10 + 300).cast("double").alias("rpm"), depth.alias("depth_of_cut"), (F.lit(0.002) + k % 5 * 0.001).alias("feed_rate"), label.alias("label"))


@query(f"""WITH {_ORDERS}, {_PARTS}, p AS (SELECT path, split_part(split_part(path, '/', 2), '.mat', 1) AS stem, nullif(replace(regexp_extract(path, '([0-9]+(?:p[0-9]+)?)inch', 1), 'p', '.'), '') AS stick FROM files),
n AS (SELECT path, CAST(stick AS DOUBLE) AS stickout, CAST(split_part(stem, '_', 2) AS DOUBLE) AS rpm, CAST(nullif(regexp_extract(split_part(stem, '_', 3), '^([0-9]+)', 1), '') AS DOUBLE) / 1000 AS depth_of_cut, split_part(stem, '_', 1) AS prefix, split_part(stem, '_', 4) AS run FROM p),
i AS (SELECT *, CASE WHEN depth_of_cut IS NOT NULL THEN 'ld_' || stickout || '_rpm_' || CAST(rpm AS BIGINT) || '_doc_' || depth_of_cut || '_state_' || prefix || '_run_' || run END AS recording_id FROM n),
g AS (SELECT *, count(*) OVER (PARTITION BY recording_id) AS copies FROM i),
c AS (SELECT DISTINCT stickout, rpm, depth_of_cut FROM n WHERE depth_of_cut IS NOT NULL), r AS (SELECT stickout, rpm, depth_of_cut, min(ord) AS ord FROM meta GROUP BY 1, 2, 3),
t AS (SELECT c.*, min(ord) AS ord, 'tight' AS match FROM c JOIN r ON abs(c.stickout - r.stickout) <= 1e-9 * greatest(1, c.stickout, r.stickout) AND abs(c.rpm - r.rpm) <= 1e-9 * greatest(1, c.rpm, r.rpm) AND abs(c.depth_of_cut - r.depth_of_cut) <= 5e-7 GROUP BY ALL),
l AS (SELECT c.*, min(ord) AS ord, 'loose' AS match FROM c JOIN r ON abs(c.stickout - r.stickout) < 0.1 AND abs(c.rpm - r.rpm) <= 1e-9 * greatest(1, c.rpm, r.rpm) AND abs(c.depth_of_cut - r.depth_of_cut) < 0.001 WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.stickout = c.stickout AND t.rpm = c.rpm AND t.depth_of_cut = c.depth_of_cut) GROUP BY ALL),
m AS (SELECT * FROM t UNION ALL SELECT * FROM l)
SELECT recording_id, path, g.stickout AS stickout, g.rpm AS rpm, g.depth_of_cut AS depth_of_cut, CAST(coalesce(feed_rate, 0.002) AS DOUBLE) AS feed_rate, coalesce(meta.label, CASE prefix WHEN 's' THEN 'stable' WHEN 'i' THEN 'incipient' ELSE 'chatter' END) AS label, run AS experiment_run_id,
 coalesce(match, 'name') AS match, m.ord AS ord, CASE WHEN g.depth_of_cut IS NULL THEN 'speed or depth can''t be read' WHEN recording_id IS NOT NULL AND copies > 1 THEN 'several paths have this id' END AS problem
FROM g LEFT JOIN m ON m.stickout = g.stickout AND m.rpm = g.rpm AND m.depth_of_cut = g.depth_of_cut LEFT JOIN meta ON meta.ord = m.ord""")
def dataset_index(spark, sf_dir):
    made = X.dataset_index(order_paths(spark, sf_dir), part_conditions(spark, sf_dir))
    return made.drop("tooth_count", "tool_id", "machine_id", "sensor_id", "chatter_onset_time")


# --- leaving one group out: windows of suppliers' recordings, fast or slow spindles -------------------------------------

TIME = ["time_rms", "time_variance", "time_std", "time_peak_to_peak", "time_mean_absolute", "time_crest_factor", "time_kurtosis", "time_skewness", "time_impulse_factor", "time_shape_factor", "time_clearance_factor", "time_zero_crossing_rate"]
GROUPINGS = ["recording_id", "stickout", "rpm"]


def labelled_windows(spark, sf_dir):
    m = S.machining_metadata(spark, sf_dir).select("recording_id", "stickout", "rpm", (F.col("rpm") > 480).cast("int").alias("y"))
    return keep(features_of(spark, sf_dir).join(m, "recording_id"), "windows")  # read several times


def _out_of_fold(grouping: str, rows: str = "lg", name: str = "") -> str:
    """Scores of the diagonal discriminant by SQL; the fold's statistics are all groups' less its own."""
    return f"""st_{name}{grouping} AS (SELECT {grouping} AS g, f, sum(y) AS n1, count(*) - sum(y) AS n0, sum(x * y) AS s1, sum(x * (1 - y)) AS s0, sum(x * x) AS q FROM {rows} GROUP BY 1, 2),
tr_{name}{grouping} AS (SELECT g, f, sum(n1) OVER w - n1 AS n1, sum(n0) OVER w - n0 AS n0, sum(s1) OVER w - s1 AS s1, sum(s0) OVER w - s0 AS s0, sum(q) OVER w - q AS q FROM st_{name}{grouping} WINDOW w AS (PARTITION BY f)),
sc_{name}{grouping} AS (SELECT g, f, n1, n0, (s0 + s1) / (n0 + n1) AS m, coalesce(nullif(sqrt(greatest(q / (n0 + n1) - pow((s0 + s1) / (n0 + n1), 2), 0)), 0), 1) AS sd, s1 / n1 AS m1, s0 / n0 AS m0, (q - s0 * s0 / n0 - s1 * s1 / n1) / (n0 + n1) AS v FROM tr_{name}{grouping}),
oof_{name}{grouping} AS (SELECT recording_id, window_index, max(y) AS y, round(1 / (1 + exp(-sum((m1 - m0) / sd / (v / (sd * sd) + 0.001) * ((x - m) / sd - (m1 + m0 - 2 * m) / sd / 2)))), 9) AS score FROM {rows} r JOIN sc_{name}{grouping} s ON s.g = r.{grouping} AND s.f = r.f WHERE n1 > 0 AND n0 > 0 GROUP BY 1, 2)"""


_LABELLED = f"""{METADATA}, w AS ({FEATURES_SQL}), c AS (SELECT * FROM w WHERE {" AND ".join(f"{n} IS NOT NULL" for n in TIME)}),
cn AS ({" UNION ALL ".join(f"SELECT recording_id, window_index, '{n}' AS f, {n} - avg({n}) OVER () AS x FROM c" for n in TIME)}), lg AS (SELECT cn.*, stickout, rpm, CASE WHEN rpm > 480 THEN 1 ELSE 0 END AS y FROM cn JOIN meta USING (recording_id))"""


def _metrics_sql(source: str, score: str = "score", predicted: str = "score >= 0.5") -> str:
    return f"""(SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
 round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, (tp + tn) / (tp + fp + fn + tn)), 6) AS balanced_accuracy, round(auc, 6) AS auc
FROM (SELECT count(*) FILTER (WHERE y = 1 AND {predicted}) AS tp, count(*) FILTER (WHERE y = 0 AND {predicted}) AS fp, count(*) FILTER (WHERE y = 1 AND NOT ({predicted})) AS fn, count(*) FILTER (WHERE y = 0 AND NOT ({predicted})) AS tn FROM {source}),
(SELECT sum(neg * (above + pos / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM (SELECT pos, neg, coalesce(sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM (SELECT {score} AS s, sum(y) AS pos, count(*) - sum(y) AS neg FROM {source} GROUP BY 1))))"""


def _rounded(df):
    return df.select(*[(r6(F.col(c)) if t == "double" else F.col(c)).alias(c) for c, t in df.dtypes])


@query(f"WITH {_LABELLED}, " + ", ".join(map(_out_of_fold, GROUPINGS)) + " " + " UNION ALL ".join(f"SELECT '{g}' AS grouping, * FROM {_metrics_sql(f'oof_{g}')}" for g in GROUPINGS))
def leave_one_group_out(spark, sf_dir):
    rows = labelled_windows(spark, sf_dir)
    parts = [L.pooled_metrics(L.leave_one_group_out(rows, TIME, "y", g, "diagonal").withColumn("score", F.round("score", 9))).withColumn("grouping", F.lit(g)) for g in GROUPINGS]
    return _rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query()
def leave_one_group_out_full(spark, sf_dir):
    """The discriminant with a pooled covariance, and the ablations of level and shape features."""
    subsets = {"all": TIME, "level": TIME[:5], "shape": TIME[5:]}
    return _rounded(L.ablation(labelled_windows(spark, sf_dir), subsets, "y", GROUPINGS))


_SMOOTH = """m AS (SELECT recording_id, n, y, p, lag(p, 1) OVER w AS b1, lag(p, 2) OVER w AS b2, lead(p, 1) OVER w AS a1, lead(p, 2) OVER w AS a2, first_value(p) OVER (PARTITION BY recording_id ORDER BY n) AS f, last_value(p) OVER (PARTITION BY recording_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS e FROM sig WINDOW w AS (PARTITION BY recording_id ORDER BY n)),
sm AS (SELECT recording_id, n, y, p, list_sort([coalesce(b2, f), coalesce(b1, f), p, coalesce(a1, e), coalesce(a2, e)])[3] AS smoothed FROM m)"""


# --- temporal evaluation: out-of-fold sequences of each recording, smoothed ----------------------------------------------

_TEMPORAL = f"""{_LABELLED}, {_out_of_fold("recording_id")}, sig AS (SELECT recording_id, window_index AS n, y, score AS p FROM oof_recording_id), {_SMOOTH},
marks AS (SELECT *, CASE WHEN smoothed >= 0.75 THEN 1 WHEN smoothed < 0.4 THEN 0 END AS mark FROM sm),
st AS (SELECT recording_id, n, y, p, smoothed, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY n ROWS UNBOUNDED PRECEDING), 0) AS state FROM marks),
ch AS (SELECT *, CASE WHEN state <> coalesce(lag(state) OVER (PARTITION BY recording_id ORDER BY n), -1) THEN 1 ELSE 0 END AS new FROM st),
ru AS (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY n) AS run FROM ch),
lab AS (SELECT recording_id, n, y, p, smoothed, CASE WHEN state = 1 AND count(*) OVER (PARTITION BY recording_id, run) >= 3 THEN 1 ELSE 0 END AS label FROM ru)"""


def temporal_sequences(spark, sf_dir):
    """(recording_id, n, y, p, smoothed, label): each recording's out-of-fold probabilities in order, their running median of five, and labels by hysteresis and runs."""
    scored = L.leave_one_group_out(labelled_windows(spark, sf_dir), TIME, "y", "recording_id", "diagonal").filter("score IS NOT NULL")
    rows = scored.select("recording_id", F.col("window_index").alias("n"), F.col("__y").alias("y"), F.round("score", 9).alias("p"))
    return W.smooth_labels(rows, 0.75, 0.40, 3, width=5).select("recording_id", "n", "y", "p", "smoothed", "label")


@query(f"WITH {_TEMPORAL} SELECT recording_id, n, y, round(p, 6) AS p, round(smoothed, 6) AS smoothed, CAST(label AS INTEGER) AS label FROM lab")
def temporal_labels(spark, sf_dir):
    return temporal_sequences(spark, sf_dir).select("recording_id", "n", "y", r6(F.col("p")).alias("p"), r6(F.col("smoothed")).alias("smoothed"), "label")


@query(f"WITH {_TEMPORAL} " + " UNION ALL ".join(f"SELECT '{name}' AS labels, * FROM {_metrics_sql('lab', score, predicted)}" for name, score, predicted in (("raw", "p", "p >= 0.5"), ("smoothed", "smoothed", "smoothed >= 0.5"), ("runs", "smoothed", "label = 1"))))
def temporal_evaluation(spark, sf_dir):
    """Metrics of the windows by their own probability, by the smoothed one, and by the labels of hysteresis and runs."""
    rows = temporal_sequences(spark, sf_dir).withColumn("__y", F.col("y"))
    raw = L.pooled_metrics(rows.withColumn("score", F.col("p")))
    smooth = L.pooled_metrics(rows.withColumn("score", F.col("smoothed")))
    runs = D.confusion(rows, "__y", "label").crossJoin(smooth.select("auc"))  # one row each
    named = [df.withColumn("labels", F.lit(n)) for n, df in (("raw", raw), ("smoothed", smooth), ("runs", runs))]
    return _rounded(named[0].unionByName(named[1]).unionByName(named[2]))


@query()
def permutation_importance(spark, sf_dir):
    return L.permutation_importance(labelled_windows(spark, sf_dir), TIME, "y", "recording_id", ["recording_id", "window_index"])


@query(f"""WITH {_TEMPORAL}, df AS (SELECT round(abs(p - y) - abs(smoothed - y), 6) AS d FROM lab), nz AS (SELECT d, abs(d) AS a FROM df WHERE d <> 0),
rk AS (SELECT d, a, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS r FROM nz), ti AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM nz GROUP BY a)),
rs AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS minus FROM rk)
SELECT n, round(plus, 3) AS plus, round(minus, 3) AS minus, round(plus, 3) AS statistic, round((plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM rs, ti""")
def smoothing_wilcoxon(spark, sf_dir):
    """Whether smoothed probabilities are nearer to the truth: signed ranks of the two errors of each window. The p-value has no SQL here."""
    rows = temporal_sequences(spark, sf_dir).select(F.abs(F.col("p") - F.col("y")).alias("raw"), F.abs(F.col("smoothed") - F.col("y")).alias("smooth"))
    made = D.wilcoxon(rows, "raw", "smooth", "greater", digits=6)
    return made.select("n", *[F.round(c, 3).alias(c) for c in ("plus", "minus", "statistic")], r6(F.col("z")).alias("z"))


@query()
def perturbation_stability(spark, sf_dir):
    return L.perturbation_stability(labelled_windows(spark, sf_dir), TIME, "y", "recording_id", ["recording_id", "window_index"])


# --- models by setting ---------------------------------------------------------------------------------------------------

SUBSETS = {"all": TIME, "level": TIME[:5], "shape": TIME[5:]}


def _subset(name: str) -> str:
    return f"r_{name} AS (SELECT * FROM lg WHERE f IN ({', '.join(repr(f) for f in SUBSETS[name])}))"


@query(f"WITH {_LABELLED}, " + ", ".join(map(_subset, SUBSETS)) + ", " + ", ".join(_out_of_fold(g, f"r_{m}", f"{m}_") for m in SUBSETS for g in GROUPINGS) + ", sco AS (" + " UNION ALL ".join(f"SELECT '{g}' AS setting, '{m}' AS model, auc, f1 FROM {_metrics_sql(f'oof_{m}_{g}')}" for m in SUBSETS for g in GROUPINGS)
 + "), be AS (SELECT model, count(*) AS wins FROM (SELECT *, row_number() OVER (PARTITION BY setting ORDER BY coalesce(auc, -1) DESC, model) AS k FROM sco) WHERE k = 1 GROUP BY 1) SELECT model, round(auc, 5) AS auc, round(f1, 5) AS f1, coalesce(wins, 0) AS wins, row_number() OVER (ORDER BY auc DESC, model) AS place FROM (SELECT model, avg(auc) AS auc, avg(f1) AS f1 FROM sco GROUP BY 1) LEFT JOIN be USING (model)")
def model_ranking(spark, sf_dir):
    """Feature subsets as models and groupings as settings: means, wins and places."""
    rows, parts = labelled_windows(spark, sf_dir), []
    for m, names in SUBSETS.items():
        for g in GROUPINGS:
            scored = L.leave_one_group_out(rows, names, "y", g, "diagonal").withColumn("score", F.round("score", 9))
            parts.append(L.pooled_metrics(scored).select(F.lit(g).alias("setting"), F.lit(m).alias("model"), r6(F.col("auc")).alias("auc"), r6(F.col("f1")).alias("f1")))
    scores = parts[0]
    for p in parts[1:]:
        scores = scores.unionByName(p)
    made = A.model_ranking(keep(scores, "scores"), "setting", "model", "auc", ["f1"])
    return made.select("model", F.round("auc", 5).alias("auc"), F.round("f1", 5).alias("f1"), "wins", F.col("place").cast("long").alias("place"))


@query(f"""WITH {_ORDERS}, n AS (SELECT path, split_part(split_part(path, '/', 2), '.mat', 1) AS stem FROM files)
SELECT path, split_part(stem, '_', 1) AS label, TRY_CAST(regexp_replace(split_part(stem, '_', 2), '[^0-9.]', '', 'g') AS DOUBLE) AS rpm, TRY_CAST(regexp_replace(split_part(stem, '_', 3), '[^0-9.]', '', 'g') AS DOUBLE) AS feed FROM n""")
def evaluation_names(spark, sf_dir):
    paths = order_paths(spark, sf_dir)
    return paths.select("path", *[c.alias(n) for n, c in E.evaluation_name(F.col("path")).items()])


@query(r"""WITH l AS (SELECT event_id, event_type || ',' || CASE event_id % 6 WHEN 0 THEN 'NaN' WHEN 1 THEN '-inf' WHEN 2 THEN 'nano' ELSE CAST(user_id AS VARCHAR) END || CASE WHEN event_id % 4 = 0 THEN ', v' || user_id || '.2.' || event_id ELSE '' END AS line FROM events)
SELECT event_id, regexp_matches(lower(line), '(^|[,\s])(nan|[-+]?inf)($|[,\s])') AS nonfinite, nullif(regexp_extract(line, '[0-9]+\.[0-9]+\.[0-9]+', 0), '') AS version FROM l""")
def scanned_lines(spark, sf_dir):
    """Lines of events as separated values: tokens that are no numbers, and version numbers."""
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    value = F.when(e % 6 == 0, "NaN").when(e % 6 == 1, "-inf").when(e % 6 == 2, "nano").otherwise(u)
    tail = F.when(e % 4 == 0, F.concat(F.lit(", v"), u, F.lit(".2."), e.cast("string"))).otherwise("")
    lines = S.read(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit(","), value, tail).alias("line"))
    return lines.select("event_id", E.has_nonfinite_token(F.col("line")).alias("nonfinite"), E.version(F.col("line")).alias("version"))
