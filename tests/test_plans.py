"""Plans keep the shape that large inputs need."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF

JOINS = [
    "point_in_polygon", "distance_join", "buffer_search", "nearest_seed", "nearest_polygon", "line_intersections", "trigram_title_similarity",
    "fulltext_rank", "layer_upsert", "session_usage", "embedding_cache_lookup", "feature_pixel_extents",
]


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JOINS)
def test_every_join_has_a_key(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text


@pytest.mark.parametrize("name", ["fulltext_search", "chat_history", "buffer_search", "semantic_chunks"])
def test_top_k_is_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


@pytest.mark.parametrize("name, unread", [("content_hashes", "lang"), ("latest_row_wins", "o_orderpriority"), ("body_font_sizes", "source")])
def test_unused_columns_are_not_read(spark, name, unread):
    schemas = [line for line in plan(spark, name).split("\n") if "ReadSchema" in line]
    assert schemas and all(unread not in line.split("ReadSchema")[1] for line in schemas)



def test_nearest_polygon_deals_its_pairs_over_a_fixed_number_of_tasks(spark):
    """Few bytes of points and cells make many pairs: each window and the last join have an explicit number of tasks."""
    plan = entry.queries()["nearest_polygon"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [point_id") == 4 and plan.count("RepartitionByExpression [px") == 2
