"""Queries on nested documents (events with their properties, flattened, and the entries they lack) and on runs that are taken up again."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.operators import documents as D
from tremor.operators import runs as R
from tremor.operators.tables import shared_folder
from tremor.plans.registry import query
from tremor.sources import signals as S

_DOCS = """docs AS (SELECT event_id, '{"Event Type":"' || event_type || '","run":{"props":' || props || ',"values":[' || user_id || ',{"Sub-Key":' || CASE WHEN event_id % 3 = 0 THEN '[true,null]' ELSE '"x y"' END || '}]}' || CASE WHEN event_id % 5 = 0 THEN ',"Peak freq (Hz)":' || event_id % 7 ELSE '' END || '}' AS d FROM events)"""
_FLAT = f"""{_DOCS}, flat AS (SELECT event_id, regexp_replace(regexp_replace(lower(fullkey), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS path, t.type AS type, CASE WHEN t.type IN ('OBJECT', 'ARRAY') THEN CAST(t.value AS VARCHAR) ELSE t.value ->> '$' END AS value
FROM docs, json_tree(d) AS t WHERE fullkey <> '$')"""


def event_documents(spark, sf_dir):
    e = F.col("event_id")
    inner = F.when(e % 3 == 0, "[true,null]").otherwise('"x y"')
    peak = F.when(e % 5 == 0, F.concat(F.lit(',"Peak freq (Hz)":'), (e % 7).cast("string"))).otherwise("")
    d = F.concat(F.lit('{"Event Type":"'), "event_type", F.lit('","run":{"props":'), "props", F.lit(',"values":['), F.col("user_id").cast("string"), F.lit(',{"Sub-Key":'), inner, F.lit("}]}"), peak, F.lit("}"))
    return S.read(spark, sf_dir, "events").select("event_id", d.alias("d"))


@query(f"WITH {_FLAT} SELECT event_id, path, type IN ('OBJECT', 'ARRAY') AS container, CASE WHEN type NOT IN ('OBJECT', 'ARRAY') THEN value END AS value FROM flat")
def flattened_documents(spark, sf_dir):
    made = D.flattened(event_documents(spark, sf_dir), "event_id", "d")
    container = F.col("kind").isin("object", "array")
    return made.select("event_id", "path", container.alias("container"), F.when(~container, F.col("value")).alias("value"))


WANTED = {"event_type": ["event_type"], "peak_frequency": ["peak_hz", "dominant_frequency"], "sub_key": ["values_sub_key"], "first_value": ["run_0"], "key": ["props_k"], "absent": ["nothing_like_it"]}


@query(f"""WITH {_FLAT}, n AS (SELECT count(DISTINCT event_id) AS records FROM flat), w(requirement, a, r) AS (VALUES {", ".join(f"('{n}', '{a}', '(^|_){'_(.*_)?'.join(a.split('_'))}(_|$)')" for n, aliases in WANTED.items() for a in aliases)})
SELECT requirement, any_value(records) AS records, any_value(records) - count(DISTINCT event_id) AS missing FROM w CROSS JOIN n LEFT JOIN flat ON contains(path, a) OR regexp_matches(path, r) GROUP BY 1""")
def required_entries(spark, sf_dir):
    return D.requirements(D.flattened(event_documents(spark, sf_dir), "event_id", "d"), "event_id", WANTED)


# --- a run that is taken up again ---------------------------------------------------------------------------------------


def level_of(x: np.ndarray) -> tuple[float]:
    """Root mean square; a value over 1000 is an error."""
    if np.abs(x).max() > 1000:
        raise ValueError("out of range")
    return (float(np.sqrt(np.mean(x * x))),)


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * CASE WHEN vec_id % 10 = 0 THEN 2 ELSE 1 END) AS x, vec_id % 50 = 7 AS bad FROM embeddings WHERE vec_id % 13 <> 0)
SELECT CAST(vec_id AS VARCHAR) AS recording_id, CASE WHEN bad THEN 'failed' ELSE 'done' END AS status, CASE WHEN bad THEN 'ValueError: out of range' END AS error, vec_id % 10 = 0 OR bad AS touched, CASE WHEN NOT bad THEN round(sqrt(list_avg(list_transform(x, lambda y: y * y))), 6) END AS level FROM v""")
def resumed_run(spark, sf_dir):
    """The second of two runs: a tenth of the vectors has changed, a thirteenth is gone, and a fiftieth fails in both."""
    rows = S.embedding_arrays(spark, sf_dir)
    k = F.col("recording_id")
    broken = rows.withColumn("x", F.when(k % 50 == 7, F.transform("x", lambda v: F.lit(1e6))).otherwise(F.col("x")))
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    fields = [T.StructField("level", T.DoubleType())]
    R.run_dataset(broken, folder, level_of, fields, "level, 1")
    later = broken.withColumn("x", F.when(k % 10 == 0, F.transform("x", lambda v: v * 2)).otherwise(F.col("x"))).filter(k % 13 != 0)
    manifest = R.run_dataset(later, folder, level_of, fields, "level, 1")
    results = spark.read.parquet(f"{folder}/results").select("recording_id", F.round("level", 6).alias("level"))
    return manifest.join(results, "recording_id", "left").select("recording_id", "status", "error", "touched", "level")
