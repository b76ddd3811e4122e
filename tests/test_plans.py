"""Plans: pruning, pushdown, limits before the shuffle, and no joins that compare everything."""

import pytest
from conftest import SF_DIR

import __spark_entry__ as entry

QUERIES = entry.queries()


def plan(spark, name):
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark):
    text = plan(spark, "pass_at_k")
    assert "l_partkey" in text and "l_extendedprice" not in text
    assert "html" not in plan(spark, "source_detect")


@pytest.mark.parametrize("name", ["vote_submission", "retention_latest_n", "top_children", "lsh_topk", "verified_examples", "distlearn_batch", "epoch_examples"])
def test_rank_limits_apply_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


GRID_QUERIES = [
    n for n in QUERIES
    if n.startswith("grid_") and n not in {
        "grid_histogram", "grid_augment_dedup", "grid_patches", "grid_problem_aug", "grid_difficulty", "grid_pso", "grid_select",
        "grid_writers", "grid_concat", "grid_cellwise",
    }
]


@pytest.mark.parametrize("name", GRID_QUERIES)
def test_grid_functions_do_not_shuffle_by_key(spark, name):
    assert "hashpartitioning" not in plan(spark, name)


def test_aggregates_are_partial_first(spark):
    text = plan(spark, "grid_augment_dedup")
    assert text.count("HashAggregate") == 2 and "partial_min" in text
