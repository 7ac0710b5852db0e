"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import harness

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return harness.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, con, name):
    n, _, bad, _ = harness.compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), FOLDER)
    assert bad is None, bad
    assert n > 0 or name in entry.oracle_sql()


LONG = ["utterances", "estimated_max_gap", "gap_histogram", "attach_slides_by_midpoint", "attach_slide_text_all",
        "normalize_ends", "filter_by_text_change", "packed_units_128_overlap_13", "limited_segments", "boundary_errors",
        "tolerance_match", "min_gap_boundaries", "knn_in_lecture"]


@pytest.mark.parametrize("name", LONG)
def test_query_with_long_keys_equals_sql(spark, con, tiny_blocks, name):
    _, _, bad, _ = harness.compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert bad is None, bad


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
