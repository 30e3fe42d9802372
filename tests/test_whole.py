"""Queries that must cover their whole tables."""

import json

import pytest
from pyspark.sql import functions as F

from isobar.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["index_day_percentiles", "index_spell_durations"])
def test_all_cells_and_years(spark, name):
    of = lambda df: {tuple(r) for r in df.distinct().collect()}
    cells = catalog.daily(spark, DIR).df.select("x", "y", F.year("time").alias("year"))
    assert of(catalog.QUERIES[name](spark, DIR).select("x", "y", "year")) == of(cells)


def test_sink_has_all_events(spark):
    found = [json.loads(r.value)["properties"]["gid"] for r in catalog.QUERIES["sink_geojson"](spark, DIR).collect()]
    assert sorted(found) == sorted(r[0] for r in spark.read.parquet(f"{DIR}/events.parquet").select("event_id").collect())


def test_mask_has_all_times(spark):
    assert catalog.QUERIES["mask_cascade"](spark, DIR).count() == spark.read.parquet(f"{DIR}/lineitem.parquet").count()


def test_stack_has_all_events(spark):
    assert catalog.QUERIES["set_stack"](spark, DIR).count() == spark.read.parquet(f"{DIR}/events.parquet").count()


def test_queries_stay_without_an_optional_library(monkeypatch, capsys):
    import sys

    import __spark_entry__ as entry

    for name in [x for x in sys.modules if x == "corpus_pipeline" or x.startswith("isobar.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.SQL)
    assert "queries left out" in capsys.readouterr().err
