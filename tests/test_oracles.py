"""Every registered query against its oracle SQL on the smallest tables."""

import pytest
from conftest import SF_DIR
from oracle import compare, connect

import __spark_entry__ as entry

QUERIES, SQLS = entry.queries(), entry.oracle_sql()

# Queries with an order-dependent operator, run again with keys that must be cut into blocks.
ORDERED = [
    "transitions", "novelty_bonus", "prompt_last5", "latency_stats", "running_stats", "ema", "epoch_batches",
    "stride_shards", "test_batches", "sink_batches", "resume_rows", "difficulty_slices", "difficulty_balance",
    "balanced_shards", "telemetry_diagnosis", "conversation_roundtrip", "shaped_reward", "stream_novelty",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_oracle(spark, con, name):
    problem = compare(spark, con, SF_DIR, name, QUERIES[name], SQLS.get(name))
    assert problem in ("", "both empty"), problem


@pytest.mark.parametrize("name", ORDERED)
def test_blocked_layout_gives_the_same_result(spark, con, small_tasks, name):
    problem = compare(spark, con, SF_DIR, name, QUERIES[name], SQLS[name])
    assert not problem, problem


def test_entry_and_registry_agree(spark):
    assert set(SQLS) <= set(QUERIES)
    assert entry.entry(spark).limit(1).count() == 1
