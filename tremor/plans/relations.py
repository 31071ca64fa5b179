"""Queries on metadata joins, aggregates, detection and provenance tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremor.functions.expressions import label_number, normalise_header, path_identifier, r6, safe_identifier, standard_label
from tremor.operators import aggregates as A
from tremor.operators import detection as D
from tremor.operators import learning as L
from tremor.operators import metadata as J
from tremor.operators import validation as V
from tremor.plans.registry import METADATA, SCORES, query
from tremor.plans.time_domain import FEATURES_SQL, features_of
from tremor.sources import signals as S

# --- metadata ----------------------------------------------------------------------------------------------------------

_FILES = """files AS (SELECT DISTINCT l_suppkey AS recording_id, 'f' || l_suppkey % 7 || '/r' || (CASE WHEN l_suppkey % 9 = 0 THEN l_suppkey - l_suppkey % 27 ELSE l_suppkey END) || '.mat' AS path FROM lineitem)"""
_META = """meta AS (SELECT s_suppkey AS ord, CASE WHEN s_suppkey % 3 = 0 THEN 'f' || s_suppkey % 7 || '\\r' || s_suppkey WHEN s_suppkey % 3 = 1 THEN 'f' || s_suppkey % 7 || '/r' || (s_suppkey - s_suppkey % 2) || '.mat' ELSE 'r' || s_suppkey || '.mat' END AS path, 300.0 + s_suppkey % 7 * 60 AS rpm FROM supplier)"""
_NORM = """norm AS (SELECT ord, rpm, CASE WHEN regexp_matches(replace(path, '\\', '/'), '\\.[A-Za-z0-9]+$') THEN replace(path, '\\', '/') ELSE replace(path, '\\', '/') || '.mat' END AS path FROM meta)"""


def files(spark, sf_dir):
    k = F.col("l_suppkey")
    ids = S.read(spark, sf_dir, "lineitem").select(k).distinct()
    name = F.when(k % 9 == 0, k - k % 27).otherwise(k)
    return ids.select(k.alias("recording_id"), F.concat(F.lit("f"), (k % 7).cast("string"), F.lit("/r"), name.cast("string"), F.lit(".mat")).alias("path"))


def metadata(spark, sf_dir):
    k = F.col("s_suppkey")
    s, folder = k.cast("string"), F.concat(F.lit("f"), (k % 7).cast("string"))
    path = (
        F.when(k % 3 == 0, F.concat(folder, F.lit("\\r"), s)).when(k % 3 == 1, F.concat(folder, F.lit("/r"), (k - k % 2).cast("string"), F.lit(".mat"))).otherwise(F.concat(F.lit("r"), s, F.lit(".mat")))
    )
    return S.read(spark, sf_dir, "supplier").select(k.alias("ord"), path.alias("path"), (F.lit(300.0) + k % 7 * 60).alias("rpm"))


@query(f"WITH {_FILES}, {_META}, {_NORM}, f1 AS (SELECT * FROM norm QUALIFY row_number() OVER (PARTITION BY path ORDER BY ord) = 1) SELECT recording_id, files.path, ord, rpm FROM files LEFT JOIN f1 ON f1.path = files.path")
def metadata_path_join(spark, sf_dir):
    return J.path_join(files(spark, sf_dir), metadata(spark, sf_dir), "ord").select("recording_id", "path", "ord", "rpm")


@query(f"""WITH {_FILES}, {_META}, {_NORM}, c AS (SELECT split_part(path, '/', -1) AS b, count(*) AS n, min(path) AS f FROM files GROUP BY 1)
SELECT ord, coalesce(n, 0) AS candidates, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'unmappable' END AS status, CASE WHEN n = 1 THEN f END AS file FROM norm LEFT JOIN c ON c.b = split_part(norm.path, '/', -1)""")
def metadata_basename_fallback(spark, sf_dir):
    return J.basename_join(files(spark, sf_dir), metadata(spark, sf_dir)).select("ord", "candidates", "status", "file")


@query(f"WITH {_FILES}, {_META}, {_NORM} SELECT recording_id, path FROM files WHERE path NOT IN (SELECT path FROM norm)")
def metadata_missing_anti(spark, sf_dir):
    known = metadata(spark, sf_dir).select(J.normalised_path(F.col("path")).alias("path"))
    return files(spark, sf_dir).join(known, "path", "left_anti").select("recording_id", "path")


@query(f"WITH {_FILES}, {_META}, {_NORM} SELECT recording_id, path FROM files WHERE path IN (SELECT path FROM norm)")
def metadata_present_semi(spark, sf_dir):
    known = metadata(spark, sf_dir).select(J.normalised_path(F.col("path")).alias("path"))
    return files(spark, sf_dir).join(known, "path", "left_semi").select("recording_id", "path")


@query(f"WITH {_FILES}, {_META}, {_NORM}, f1 AS (SELECT * FROM norm QUALIFY row_number() OVER (PARTITION BY path ORDER BY ord) = 1) SELECT count(*) AS total, CAST(count(ord) AS BIGINT) AS matched, CAST(count(*) - count(ord) AS BIGINT) AS missing, (SELECT count(*) FROM norm) - (SELECT count(*) FROM f1) AS ambiguous FROM files LEFT JOIN f1 ON f1.path = files.path")
def metadata_index_report(spark, sf_dir):
    m = metadata(spark, sf_dir)
    joined = J.path_join(files(spark, sf_dir), m, "ord").agg(F.count("*").alias("total"), F.count("ord").alias("matched"))
    copies = m.groupBy(J.normalised_path(F.col("path")).alias("p")).count().agg(F.sum(F.col("count") - 1).alias("ambiguous"))
    return joined.crossJoin(copies).select("total", "matched", (F.col("total") - F.col("matched")).alias("missing"), "ambiguous")  # one row each


@query(f"WITH {METADATA} SELECT a.recording_id, p_partkey, a.rpm FROM meta a JOIN part ON abs(a.depth_of_cut * 100000 - p_retailprice) <= 2.5 AND a.stickout = 2.0 + p_size % 3 * 0.5")
def metadata_band_join(spark, sf_dir):
    a = S.machining_metadata(spark, sf_dir).select("recording_id", "rpm", "stickout", (F.col("depth_of_cut") * 100000).alias("depth"))
    b = S.read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("depth"), (F.lit(2.0) + F.col("p_size") % 3 * 0.5).alias("stickout"))
    return J.band_join(a, b, "depth", 2.5, F.lit(True), ["stickout"]).select("recording_id", "p_partkey", "rpm")


_PATHS = "paths AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN page_id % 5 || 'p' || page_id % 10 ELSE CAST(page_id % 5 AS VARCHAR) END || 'inch_stickout/' || ['c','i','s','u'][page_id % 4 + 1] || '_' || (page_id % 6 * 100 + 320) || '_' || lpad(CAST(page_id % 97 AS VARCHAR), 3, '0') || '.mat' AS path FROM pages)"


@query(f"""WITH {_PATHS} SELECT page_id, path, CAST(replace(regexp_extract(path, '([0-9]+(?:p[0-9]+)?)inch', 1), 'p', '.') AS DOUBLE) AS stickout, split_part(split_part(path, '/', 2), '_', 1) AS label,
 CAST(split_part(split_part(path, '/', 2), '_', 2) AS DOUBLE) AS rpm, CAST(regexp_extract(split_part(split_part(path, '/', 2), '_', 3), '^([0-9]+)', 1) AS DOUBLE) / 1000 AS depth_of_cut FROM paths""")
def parse_condition_from_path(spark, sf_dir):
    k = F.col("page_id")
    size = F.when(k % 2 == 0, F.concat((k % 5).cast("string"), F.lit("p"), (k % 10).cast("string"))).otherwise((k % 5).cast("string"))
    label = F.get(F.array(*[F.lit(x) for x in "cisu"]), (k % 4).cast("int"))
    path = F.concat(size, F.lit("inch_stickout/"), label, F.lit("_"), (k % 6 * 100 + 320).cast("string"), F.lit("_"), F.lpad((k % 97).cast("string"), 3, "0"), F.lit(".mat"))
    rows = S.read(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", "path", *[c.alias(n) for n, c in J.condition_of(F.col("path")).items()])


@query(r"""WITH n AS (SELECT p_partkey, p_name, p_name || '/run-' || p_partkey || '_a  b.mat' AS path FROM part)
SELECT p_partkey, regexp_replace(lower(trim(p_name)), '[^a-z0-9]', '', 'g') AS header, regexp_replace(regexp_replace(regexp_replace(path, '[^\p{L}\p{N}_-]', '__', 'g'), '__(__)+(_?)', '__\2', 'g'), '^_+|_+$', '', 'g') AS metadata_id,
 regexp_replace(regexp_replace(regexp_replace(replace(path, '.mat', ''), '[^\p{L}\p{N}_-]', '__', 'g'), '__(__)+(_?)', '__\2', 'g'), '^_+|_+$', '', 'g') AS path_id FROM n""")
def normalise_headers(spark, sf_dir):
    path = F.concat("p_name", F.lit("/run-"), F.col("p_partkey").cast("string"), F.lit("_a  b.mat"))
    return S.read(spark, sf_dir, "part").select("p_partkey", normalise_header(F.col("p_name")).alias("header"), safe_identifier(path).alias("metadata_id"), path_identifier(path).alias("path_id"))


@query("SELECT page_id, sha256(html) AS digest, length(html) AS characters FROM pages")
def content_sha256(spark, sf_dir):
    return S.read(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("digest"), F.length("html").cast("long").alias("characters"))


STATES = ["No chatter", " no chatter observed", "NOCHATTER", "mild chatter", "Incipient", "intermittent", "Chatter", "stable", "", None, "1", " TRUE ", "yes", "unstable", "0"]


@query("""WITH s AS (SELECT event_type AS state, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT *, 0 FROM (VALUES ('No chatter'), (' no chatter observed'), ('NOCHATTER'), ('mild chatter'), ('Incipient'), ('intermittent'), ('Chatter'), ('stable'), (''), (NULL), ('1'), (' TRUE '), ('yes'), ('unstable'), ('0')))
SELECT state, CASE WHEN lower(coalesce(state, '')) LIKE '%no chatter%' OR lower(coalesce(state, '')) LIKE '%nochatter%' THEN 'stable' WHEN regexp_matches(lower(coalesce(state, '')), 'mild|incipient|intermittent') THEN 'incipient' ELSE 'chatter' END AS label,
 CASE WHEN lower(trim(state)) IN ('chatter','1','true','yes','unstable') THEN 1 ELSE 0 END AS number, CAST(n AS BIGINT) AS n FROM s""")
def label_standardise(spark, sf_dir):
    seen = S.read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("state")).agg(F.count("*").alias("n"))
    rows = seen.union(spark.createDataFrame([(x, 0) for x in STATES], "state string, n long"))
    return rows.select("state", standard_label(F.col("state")).alias("label"), label_number(F.col("state")).alias("number"), "n")


# --- feature tables ----------------------------------------------------------------------------------------------------

NAMES = ["time_rms", "time_std", "time_kurtosis", "time_crest_factor", "time_zero_crossing_rate"]
_LONG = f"""wide AS ({FEATURES_SQL}), lf AS (""" + " UNION ALL ".join(
    f"SELECT recording_id, window_index, '{n}' AS feature, CASE WHEN '{n}' = 'time_kurtosis' AND window_index = 0 THEN NULL ELSE {n} END AS value FROM wide" for n in NAMES
) + ")"


def long_features(spark, sf_dir):
    wide = features_of(spark, sf_dir).withColumn("time_kurtosis", F.when(F.col("window_index") != 0, F.col("time_kurtosis")))
    return A.to_long(wide, NAMES, ["recording_id", "window_index"])


def _r(df, *keys):
    return df.select(*keys, *[(r6(F.col(c)) if t == "double" else F.col(c)).alias(c) for c, t in df.dtypes if c not in keys])


@query(f"WITH {_LONG} SELECT feature, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max FROM lf GROUP BY 1")
def feature_summary_pop(spark, sf_dir):
    return _r(A.summary_population(long_features(spark, sf_dir)), "feature")


@query(f"WITH {_LONG} SELECT feature, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max FROM lf GROUP BY 1")
def feature_describe(spark, sf_dir):
    return _r(A.describe(long_features(spark, sf_dir)), "feature")


@query(f"WITH {_LONG} SELECT feature, round(coalesce(var_samp(value), 0), 6) AS variance FROM lf GROUP BY 1")
def feature_variance(spark, sf_dir):
    return long_features(spark, sf_dir).groupBy("feature").agg(r6(F.coalesce(F.var_samp("value"), F.lit(0.0))).alias("variance"))


@query(f"""WITH {_LONG} SELECT feature, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, count(*) AS total, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 6) AS fraction,
 CASE WHEN count(*) > count(value) THEN 'undefined for this window=' || (count(*) - count(value)) ELSE '' END AS reasons FROM lf GROUP BY 1""")
def feature_missingness(spark, sf_dir):
    return _r(A.missingness(long_features(spark, sf_dir)), "feature")


@query(f"""WITH {_LONG}, r AS (SELECT feature, value, CASE WHEN value IS NULL AND recording_id % 2 = 0 THEN 'undefined for this window' END AS reason FROM lf) SELECT feature, count(*) AS values, count(*) - count(value) AS nonfinite, CAST(sum(CASE WHEN value IS NULL AND reason IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unexplained,
 sum(CASE WHEN value IS NULL AND reason IS NULL THEN 1 ELSE 0 END) = 0 AS explained FROM r GROUP BY 1""")
def finite_or_explained(spark, sf_dir):
    """Which features have missing values without a reason; reasons of odd recordings are taken away."""
    rows = long_features(spark, sf_dir).withColumn("reason", F.when(F.col("recording_id") % 2 == 0, F.col("reason")))
    return A.finite_or_explained(rows, ["feature"])


@query(f"""WITH {_LONG} SELECT a.feature AS a, b.feature AS b, round(covar_pop(a.value, b.value) / nullif(stddev_pop(a.value) * stddev_pop(b.value), 0), 6) AS correlation, count(*) AS pairs
FROM lf a JOIN lf b ON a.recording_id = b.recording_id AND a.window_index = b.window_index AND a.feature <= b.feature WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2""")
def feature_correlation(spark, sf_dir):
    return _r(A.correlations(long_features(spark, sf_dir), ["recording_id", "window_index"]), "a", "b")


@query(f"WITH {_LONG} SELECT feature, count(*) AS present, CAST(count(value) AS BIGINT) AS finite, count(value) = (SELECT count(*) FROM wide) AS kept FROM lf GROUP BY 1")
def feature_alignment(spark, sf_dir):
    return V.aligned_features(long_features(spark, sf_dir))


@query(f"WITH {_LONG} SELECT recording_id, window_index, " + ", ".join(f"max(value) FILTER (WHERE feature = '{n}') AS {n}" for n in NAMES) + " FROM lf GROUP BY 1, 2")
def feature_wide_view(spark, sf_dir):
    return A.to_wide(long_features(spark, sf_dir), NAMES, ["recording_id", "window_index"])


@query(f"""WITH {METADATA}, w AS ({FEATURES_SQL}), j AS (SELECT CAST(rpm AS VARCHAR) AS rpm, CAST(stickout AS VARCHAR) AS stickout, label, time_rms FROM w JOIN meta USING (recording_id)),
g AS (SELECT 'rpm' AS grouping, rpm AS key, avg(time_rms) AS mean, count(*) AS n FROM j GROUP BY 2 UNION ALL SELECT 'stickout', stickout, avg(time_rms), count(*) FROM j GROUP BY 2 UNION ALL SELECT 'label', label, avg(time_rms), count(*) FROM j GROUP BY 2)
SELECT grouping, key, round(mean, 4) AS mean, n, round((mean - median(mean) OVER (PARTITION BY grouping)) / coalesce(nullif(stddev_pop(mean) OVER (PARTITION BY grouping), 0), 1), 4) AS z FROM g""")
def grouped_means(spark, sf_dir):
    m = S.machining_metadata(spark, sf_dir).select("recording_id", "rpm", "stickout", "label")
    made = A.grouped_means(features_of(spark, sf_dir).join(m, "recording_id"), ["rpm", "stickout", "label"], "time_rms")
    return made.select("grouping", "key", F.round("mean", 4).alias("mean"), "n", F.round("z", 4).alias("z"))


@query(f"""WITH {METADATA}, w AS ({FEATURES_SQL}), j AS (SELECT CAST(rpm AS DOUBLE) AS rpm, CAST(stickout AS DOUBLE) AS stickout, label, time_rms FROM w JOIN meta USING (recording_id))
SELECT CASE WHEN GROUPING(rpm) = 0 AND GROUPING(stickout) = 0 THEN 'rpm,stickout' WHEN GROUPING(stickout) = 0 THEN 'label,stickout' ELSE 'label' END AS grouping, label, rpm, stickout, round(avg(time_rms), 4) AS mean, count(time_rms) AS n FROM j GROUP BY GROUPING SETS ((rpm, stickout), (label, stickout), (label))""")
def means_by_conditions(spark, sf_dir):
    m = S.machining_metadata(spark, sf_dir).select("recording_id", "rpm", "stickout", "label")
    made = A.means_by(features_of(spark, sf_dir).join(m, "recording_id"), [["rpm", "stickout"], ["label", "stickout"], ["label"]], "time_rms")
    return made.withColumn("mean", F.round("mean", 4))


@query(f"WITH {_LONG} SELECT feature, round(max(CASE WHEN feature = 'time_std' THEN 0.5 ELSE 0 END), 6) AS max_difference, CAST(count(value) AS BIGINT) AS comparisons, feature <> 'time_std' AS deterministic FROM lf GROUP BY feature")
def repeatability(spark, sf_dir):
    a = long_features(spark, sf_dir)
    b = a.withColumn("value", F.when(F.col("feature") == "time_std", F.col("value") + 0.5).otherwise(F.col("value")))
    return _r(A.merge_repeatability(A.repeatability(a, b, ["recording_id", "window_index"])), "feature")


@query("SELECT s.n_nationkey AS cutoff, coalesce(c, 0) AS n FROM nation s LEFT JOIN (SELECT s_nationkey, count(*) AS c FROM supplier WHERE s_acctbal > 9000 GROUP BY 1) ON s_nationkey = n_nationkey")
def selection_frequency(spark, sf_dir):
    chosen = S.read(spark, sf_dir, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("cutoff"))
    return A.selection_frequency(S.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cutoff")), chosen, "cutoff")


_FAMILY = {"time_rms": "level", "time_std": "level", "time_kurtosis": "shape", "time_crest_factor": "shape", "time_zero_crossing_rate": "rate"}


@query(f"WITH {_LONG} SELECT CASE WHEN feature IN ('time_rms','time_std') THEN 'level' WHEN feature = 'time_zero_crossing_rate' THEN 'rate' ELSE 'shape' END AS family, round(median(abs(value)), 6) AS median_magnitude, count(DISTINCT feature) AS features FROM lf GROUP BY 1")
def family_medians(spark, sf_dir):
    catalogue = spark.createDataFrame(list(_FAMILY.items()), "feature string, family string")
    return _r(A.family_medians(long_features(spark, sf_dir), catalogue), "family")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(avg(value) - 1.96 * stddev_pop(value) / sqrt(count(value)), 6) AS low, round(avg(value) + 1.96 * stddev_pop(value) / sqrt(count(value)), 6) AS high FROM events GROUP BY 1")
def multi_seed_summary(spark, sf_dir):
    return _r(A.scalar_summary(S.read(spark, sf_dir, "events"), "event_type", "value"), "event_type")


@query("SELECT " + ", ".join(f"CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS {c}" for c in ("event_id", "ts", "user_id", "event_type", "value", "props")) + " FROM events")
def column_missingness(spark, sf_dir):
    rows = S.read(spark, sf_dir, "events")
    return rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in rows.columns])


@query("SELECT coalesce(a.k, b.k) AS segment, baseline, candidate, candidate - baseline AS delta FROM (SELECT o_orderpriority AS k, count(*) AS baseline FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) a FULL JOIN (SELECT o_orderpriority AS k, count(*) AS candidate FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) b ON a.k = b.k")
def compare_runs(spark, sf_dir):
    o = S.read(spark, sf_dir, "orders")
    part = lambda s: o.filter(F.col("o_orderstatus") == s).groupBy(F.col("o_orderpriority").alias("segment")).agg(F.count("*").alias("n"))
    return A.compare_runs(part("O"), part("P"), "segment", "n")


@query("SELECT id, a, b FROM (SELECT s_suppkey AS id, s_name AS a, NULL AS b FROM supplier UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer)")
def ragged_union(spark, sf_dir):
    a = S.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("a"))
    b = S.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("b"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT (SELECT count(*) FROM (SELECT n_name FROM nation INTERSECT SELECT n_name FROM nation WHERE n_regionkey < 3)) AS common, (SELECT count(*) FROM (SELECT n_name FROM nation UNION SELECT r_name FROM region)) AS either, (SELECT count(*) FROM (SELECT n_name FROM nation EXCEPT SELECT n_name FROM nation WHERE n_regionkey < 3)) AS dropped")
def feature_name_sets(spark, sf_dir):
    n = S.read(spark, sf_dir, "nation")
    names, some = n.select("n_name"), n.filter("n_regionkey < 3").select("n_name")
    counted = [names.intersect(some).agg(F.count("*").alias("common")), names.union(S.read(spark, sf_dir, "region").select("r_name")).distinct().agg(F.count("*").alias("either")), names.exceptAll(some).agg(F.count("*").alias("dropped"))]
    return counted[0].crossJoin(counted[1]).crossJoin(counted[2])  # one row each


# --- detection ---------------------------------------------------------------------------------------------------------

_LABELLED = "lab AS (SELECT l.doc_id, toxic, quality, CASE WHEN n_chars >= 1500 THEN 1 ELSE 0 END AS pa, CASE WHEN n_chars % 3 = 0 THEN 1 ELSE 0 END AS pb, n_chars AS score FROM labels l JOIN documents d USING (doc_id))"


def labelled(spark, sf_dir):
    d = S.read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows = S.read(spark, sf_dir, "labels").join(d, "doc_id")
    return rows.select("doc_id", "toxic", "quality", (F.col("n_chars") >= 1500).cast("int").alias("pa"), (F.col("n_chars") % 3 == 0).cast("int").alias("pb"), F.col("n_chars").alias("score"))


@query(f"""WITH {_LABELLED}, c AS (SELECT count(*) FILTER (WHERE quality = 1 AND pa = 1) AS tp, count(*) FILTER (WHERE quality <> 1 AND pa = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND pa <> 1) AS fn, count(*) FILTER (WHERE quality <> 1 AND pa <> 1) AS tn FROM lab)
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))), 6) AS f1,
 round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy FROM c""")
def confusion_metrics(spark, sf_dir):
    return _r(D.confusion(labelled(spark, sf_dir), "quality", "pa"))


@query(f"""WITH {_LABELLED}, g AS (SELECT score, count(*) FILTER (WHERE quality = 1) AS pos, count(*) FILTER (WHERE quality <> 1) AS neg FROM lab GROUP BY 1), w AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives FROM w""")
def roc_auc(spark, sf_dir):
    return _r(D.roc_auc(labelled(spark, sf_dir), "quality", "score"))


@query(f"""WITH {_LABELLED}, g AS (SELECT score, count(*) FILTER (WHERE quality = 1) AS pos, count(*) FILTER (WHERE quality <> 1) AS neg FROM lab GROUP BY 1)
SELECT score, round(sum(pos) OVER (ORDER BY score DESC) / sum(pos) OVER (), 6) AS tpr, round(sum(neg) OVER (ORDER BY score DESC) / sum(neg) OVER (), 6) AS fpr FROM g""")
def roc_curve(spark, sf_dir):
    return _r(D.roc_curve(labelled(spark, sf_dir), "quality", "score"), "score")


@query(f"WITH {_LABELLED}, c AS (SELECT count(*) FILTER (WHERE pa = quality AND pb <> quality) AS b, count(*) FILTER (WHERE pa <> quality AND pb = quality) AS c FROM lab) SELECT b, c, round((abs(b - c) - 1) ** 2 / (b + c), 6) AS statistic FROM c")
def mcnemar_counts(spark, sf_dir):
    return _r(D.mcnemar(labelled(spark, sf_dir), "quality", "pa", "pb").drop("p_value"))


@query("""WITH g AS (SELECT conv_id, CAST(max(CASE WHEN turn > 1 THEN 1 ELSE 0 END) AS INTEGER) AS class FROM conversations GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY md5(conv_id || ':7'), conv_id) AS k, count(*) OVER (PARTITION BY class) AS n FROM g)
SELECT conv_id, class, CASE WHEN k <= floor(n * 0.2 + 0.5) THEN 'test' WHEN k <= floor(n * 0.2 + 0.5) + floor(n * 0.2 + 0.5) THEN 'validation' ELSE 'train' END AS part FROM r""")
def group_split(spark, sf_dir):
    rows = S.read(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") > 1).cast("int").alias("label"))
    return D.split_groups(rows, "conv_id", "label")


@query()
def bootstrap_ci(spark, sf_dir):
    return D.bootstrap_accuracy(labelled(spark, sf_dir), "quality", "pa")


@query(f"""WITH {_LABELLED}, g AS (SELECT score, count(*) FILTER (WHERE quality = 1) AS pos, count(*) AS c FROM lab GROUP BY 1), w AS (SELECT score, pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(c) OVER (ORDER BY score DESC) AS n, sum(pos) OVER () AS p FROM g)
SELECT score, round(tp / n, 6) AS precision, round(tp / p, 6) AS recall, round(pos / p, 6) AS step FROM w""")
def precision_recall(spark, sf_dir):
    return _r(D.precision_recall(labelled(spark, sf_dir), "quality", "score"), "score")


@query()
def bootstrap_auc(spark, sf_dir):
    return D.bootstrap_auc(labelled(spark, sf_dir), "quality", "score")


def _windows_with_label(spark, sf_dir):
    m = S.machining_metadata(spark, sf_dir).select("recording_id", (F.col("rpm") > 480).cast("int").alias("y"))
    return features_of(spark, sf_dir).join(m, "recording_id")


@query()
def grouped_cross_validation(spark, sf_dir):
    return L.fold_metrics(L.grouped_predictions(_windows_with_label(spark, sf_dir), NAMES, "y", "recording_id", folds=3))


@query()
def radial_margins(spark, sf_dir):
    """Metrics by fold of the radial margin classifier with calibrated probabilities."""
    return L.fold_metrics(L.calibrated_margins(_windows_with_label(spark, sf_dir), NAMES, "y", "recording_id", folds=2, dims=128, iterations=20, most_inner=2))


@query()
def isotonic_calibration(spark, sf_dir):
    return L.calibration(labelled(spark, sf_dir), "quality", "score")


# --- scorecard ---------------------------------------------------------------------------------------------------------


@query("""WITH checks AS (SELECT CAST(event_id % 4 + 1 AS INTEGER) AS stage, event_type AS category, value > 20 AS passed FROM events), c AS (SELECT stage, category, avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END) AS share, bool_and(passed) AS clean FROM checks GROUP BY 1, 2)
SELECT stage, round(CASE WHEN bool_and(clean) THEN sum(20 * share) ELSE least(89, sum(20 * share)) END, 6) AS score, count(*) AS categories FROM c GROUP BY 1""")
def scorecard(spark, sf_dir):
    """Points of each category split evenly over its checks; a stage with any failed check is capped."""
    checks = S.read(spark, sf_dir, "events").select((F.col("event_id") % 4 + 1).cast("int").alias("stage"), F.col("event_type").alias("category"), (F.col("value") > 20).alias("passed"))
    per = checks.groupBy("stage", "category").agg(F.avg(F.col("passed").cast("double")).alias("share"), F.bool_and("passed").alias("clean"))
    points = F.sum(20 * F.col("share"))
    return per.groupBy("stage").agg(r6(F.when(F.bool_and("clean"), points).otherwise(F.least(F.lit(89.0), points))).alias("score"), F.count("*").alias("categories"))


@query("SELECT 'n' || n_nationkey AS requirement FROM nation WHERE 'n' || n_nationkey NOT IN (SELECT DISTINCT 'n' || s_nationkey FROM supplier WHERE s_suppkey % 3 = 0)")
def missing_requirements(spark, sf_dir):
    need = S.read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("requirement"))
    have = S.read(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("requirement"))
    return need.join(have, "requirement", "left_anti")


@query(f"WITH {SCORES} SELECT recording_id, count(*) AS windows, round(avg(p), 6) AS mean_score FROM sig GROUP BY 1")
def detection_timeline(spark, sf_dir):
    return S.user_scores(spark, sf_dir).groupBy("recording_id").agg(F.count("*").alias("windows"), r6(F.avg("p")).alias("mean_score"))
