"""Every registered query of the library runs; those with SQL agree with it row by row."""

import pytest

import __spark_entry__ as entry
from tests.compare import differences
from tremor.plans import registry

#: Decompositions with hundreds of trials run over the smallest tables.
SMALLEST = {"seed_stability", "matched_gate_stability", "cutoff_search", "ensemble_mode_rows", "full_pipeline_features", "dynamic_pipeline_features"}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    assert differences(entry.queries()[name](spark, sf_dir), registry.ORACLE_SQL[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    folder = sf_dir.replace("sf0.01", "sf0.001") if name in SMALLEST else sf_dir
    assert entry.queries()[name](spark, folder).count() > 0


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5
