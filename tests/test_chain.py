"""Reorg plans that must be refused, and commit buckets."""

import pytest
from pyspark.errors import PySparkException

from chainloom.operators import chain, measure


def ledger(spark, low, high, name="a"):
    return spark.createDataFrame([(h, f"{name}{h}") for h in range(low, high + 1)], "height bigint, hash string")


def test_a_branch_without_a_common_block_is_refused(spark):
    held, branch = ledger(spark, 5, 9), ledger(spark, 6, 10, "b")
    with pytest.raises(PySparkException, match="no block in common"):
        chain.plan_reorg(held, branch, floor=0).collect()
    with pytest.raises(PySparkException, match="no block in common"):
        chain.plan_reorg(held, branch, floor=0, whole_history=True).collect()


def test_a_branch_may_replace_the_first_block_of_all(spark):
    out = chain.plan_reorg(ledger(spark, 5, 9), ledger(spark, 5, 10, "b"), floor=0, whole_history=True).first()
    assert (out.height, out.new_head_hash, out.orphaned_hashes) == (5, "b10", '["a9","a8","a7","a6","a5"]')


def test_a_fork_below_the_floor_is_refused(spark):
    branch = ledger(spark, 5, 6).unionByName(ledger(spark, 7, 10, "b"))
    assert chain.plan_reorg(ledger(spark, 5, 9), branch, floor=7).first().height == 7
    with pytest.raises(PySparkException, match="undo window"):
        chain.plan_reorg(ledger(spark, 5, 9), branch, floor=8).collect()
    assert chain.plan_reorg(ledger(spark, 5, 9), ledger(spark, 5, 9), floor=0).count() == 0


def test_commits_fall_into_twelve_buckets_and_an_open_one(spark):
    assert measure.COMMIT_BUCKETS == (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 15.0, 60.0)
    df = spark.createDataFrame([("s", x) for x in (0.001, 5.0, 5.1, 15.0, 15.1, 60.0, 61.0)], "store string, seconds double")
    out = {r.bucket: (r.n, r.upto) for r in measure.commit_histogram(df).collect()}
    assert out == {0: (1, 1), 9: (1, 2), 10: (2, 4), 11: (2, 6), 12: (1, 7)}
