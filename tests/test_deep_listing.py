"""Deep pages against the plain listing."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators.catalog import sorted_listing
from pagemill.plans import deep_listing as dl


@pytest.fixture(scope="module")
def catalog(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(4), f"file{k}.txt", ".txt" if k % 3 else ".md", rng.choice([None, 0, 5, 5, rng.randrange(100)]), "ready", f"2026-08-{1 + k % 9:02d} 10:00:00") for k in range(700)]
    frame = spark.createDataFrame(rows, "id long, user_id long, filename string, file_type string, file_size long, status string, at string")
    return frame.withColumn("created_at", F.to_timestamp_ntz("at")).withColumn("updated_at", F.col("created_at")).repartition(5).cache()


@pytest.mark.parametrize(("by", "order"), [("file_size", "asc"), ("file_size", "desc"), ("created_at", "desc")])
@pytest.mark.parametrize("step", [1, 64, 10_000])
def test_pages(catalog, by, order, step):
    for filters in ({}, {"file_type": ".md"}):
        bounds = dl.boundaries(catalog, sort_by=by, sort_order=order, step=step, **filters).cache()
        rows = 700 if not filters else 234
        assert sorted(r.place for r in bounds.collect()) == list(range(0, rows, step))
        for page in (1, 3, 8, 70, 99):
            plain = sorted_listing(catalog, sort_by=by, sort_order=order, page=page, page_size=10, **filters).collect()
            assert dl.deep_page(catalog, bounds, sort_by=by, sort_order=order, page=page, page_size=10, **filters).collect() == plain


def test_nothing(catalog):
    none = catalog.limit(0)
    bounds = dl.boundaries(none)
    assert bounds.collect() == [] and dl.deep_page(none, bounds, page=2).collect() == []
