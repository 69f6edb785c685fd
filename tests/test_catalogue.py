"""Every core query against its SQL twin, and the entry points of the driver."""

import os

import pytest

from sieveworks.plans import catalogue
from tests.compare import DATA, check

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, name):
    check(spark, catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["raster_degraded", "raster_mask_facts", "raster_controls"])
def test_raster_queries(spark, name):
    df = catalogue.queries()[name](spark, DATA)
    assert df.count() == {"raster_degraded": 33, "raster_mask_facts": 1, "raster_controls": 2}[name] * 500


def test_rating_form(spark):
    form = catalogue.queries()["rating_form"](spark, DATA).cache()
    n = form.count()
    assert 500 * 20 < n <= 500 * 30 and form.agg({"position": "max"}).first()[0] == n and form.select("panel_id").distinct().count() == n


def test_option_permutation(spark):
    got = catalogue.queries()["option_permutation"](spark, DATA)
    bank = spark.read.parquet(f"{DATA}/question_bank.parquet")
    assert got.count() == bank.count() and set(got.columns) == {"question_id", "shown"}
