"""Registered queries next to their SQL on the smallest tables."""

import os

import compare
import pytest

import __spark_entry__ as entry_module

FOLDER = "/root/testdata/sf0.001"
CHECKED = (
    "recent_counts latest_per_key popular_items clean_rows content_type_heuristic extract_text_html "
    "extract_text_markdown extract_text_rst cluster_metadata log_radius_scale labeled_plot format_downloads "
    "label_fallback nearest_within spanning_edges cluster_prompts packages_output knn_exact"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")


def test_names_agree():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    query, sql = entry_module.queries()[name], entry_module.oracle_sql()[name]
    problems = compare.compare(spark, compare.database(FOLDER), name, query, sql, FOLDER)[3]
    assert problems == []
