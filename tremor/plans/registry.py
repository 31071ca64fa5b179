"""Registered queries: a function of (spark, sf_dir) under its own name, with the SQL that checks it, if SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# The signals of tremor.sources.signals in SQL.
SIGNAL = """s0 AS (SELECT l_suppkey AS recording_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS n,
  l_extendedprice / 10000.0 AS x0 FROM lineitem),
sig AS (SELECT recording_id, n, n / 100.0 AS t, x0 - avg(x0) OVER (PARTITION BY recording_id) AS x FROM s0)"""
EVENTS = """sig AS (SELECT event_type || '-' || user_id AS recording_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS n, epoch_us(ts) / 1e6 AS t, value AS x FROM events)"""
SCORES = """sig AS (SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, value / 100.0 AS p FROM events)"""
VECTORS = """sig AS (SELECT vec_id AS recording_id, CAST(i AS BIGINT) AS n, CAST(embedding[i + 1] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings))"""
METADATA = """meta AS (SELECT s_suppkey AS recording_id, 300.0 + (s_suppkey % 7) * 60 AS rpm, CASE WHEN s_suppkey % 11 <> 0 THEN CAST(s_suppkey % 4 + 1 AS INTEGER) END AS tooth_count,
  2.0 + (s_suppkey % 3) * 0.5 AS stickout, (s_suppkey % 5) * 0.005 AS depth_of_cut, n_name AS tool_identifier, r_name AS label
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
