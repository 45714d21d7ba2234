"""Registered queries against their SQL at the smallest scale; all of them with PATRONLENS_ALL=1."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_queries import compare  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
DEFAULT = [
    "rfm_cells", "rfm_two_axes", "retention_1m", "retention_3m", "abc_xyz_merged", "cohort_retention", "clean_geolocation",
    "clean_orders_items", "state_churn", "anchored_sessions_parity", "one_order_features", "history_prefixes", "sampled_histories", "group_folds",
    "poisson_churn", "clustering_table", "repeat_knots", "csv_raw_tables", "csv_orders_values", "rejected_rows", "table_page_deep",
    "merged_csv_round_trip", "geojson_outlines", "gower_knn_clusters", "density_clusters", "hierarchical_clusters",
]
#: Queries whose right result has no row at this scale.
EMPTY_AT_THE_SMALLEST: set[str] = set()
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op")] if os.environ.get("PATRONLENS_ALL") else DEFAULT

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    status, _, _, note = compare(spark, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name])
    assert status == "ok" or status == "EMPTY" and name in EMPTY_AT_THE_SMALLEST, note or status


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["rfm_cell", "rfm_segment_description", "count"]
