"""What the plans must look like: pruned scans, pushed filters, no products but those asked for."""

from __future__ import annotations

import re

import pytest

from inkfold.plans import catalogue

from .conftest import DATA

#: Queries whose result is a product, or that join one aggregated row.
NESTED_LOOPS = {"glyph_lookup_join", "glyph_key_conflicts", "dataset_build", "funnel_summary", "quantile_length_filter", "largest_sources", "frechet_distance", "quantile_summary", "described_lengths", "lenient_lines_round_trip"}


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    if not DATA.exists():
        pytest.skip("no test tables here")
    return {name: plan(q(spark, str(DATA))) for name, q in catalogue.QUERIES.items()}


def test_no_cartesian_products(plans):
    assert [n for n, p in plans.items() if "CartesianProduct" in p] == []
    assert {n for n, p in plans.items() if "BroadcastNestedLoopJoin" in p} <= NESTED_LOOPS


@pytest.mark.parametrize(
    "name, columns",
    [
        ("keep_first_dedup", {"doc_id", "text"}),
        ("token_length_filter", {"row_idx", "output"}),
        ("throughput_summary", {"predict", "usage", "latency_sec"}),
        ("quantile_length_filter", {"filename", "svg_len"}),
        ("weighted_mean_meter", {"l_returnflag", "l_discount", "l_quantity"}),
        ("lenient_json_counts", {"split", "metadata"}),
    ],
)
def test_scans_read_only_what_is_used(plans, name, columns):
    schemas = re.findall(rf"Location: [^\]]*{DATA}[^\]]*\].*?ReadSchema: struct<(.*)", plans[name])  # of the tables, not of what is stored on the way
    read = {c for s in schemas for c in re.findall(r"(?:^|,)(\w+):", re.sub(r"struct<[^>]*", "", s))}
    assert read and read <= columns


@pytest.mark.parametrize("name, text", [("type_filter_notnull", "EqualTo(o_orderstatus,F)"), ("any_field_search", "IsNotNull(style)"), ("gradable_labels", "Not(In(label"), ("decontaminate_exact", "split"), ("image_placeholders", "IsNotNull(spacings)")])
def test_filters_reach_the_scan(plans, name, text):
    assert any(text in part for part in re.findall(r"PushedFilters: (.*?), ReadSchema", plans[name]))


def test_no_python_where_spark_has_the_expression(plans):
    allowed = {"blake2_keys", "tag_word_split", "svg_bbox", "svg_bake", "svg_encode_decode", "arc_length_sampling", "icp_chamfer", "frechet_distance", "ssim", "zip_round_trip", "array_round_trip", "family_messages_read", "answered_with_retries", "rendered_images"}
    assert {n for n, p in plans.items() if re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas|MapInArrow", p)} == allowed
