"""Joins of tables that grow are by shuffles: Spark guesses sizes from compressed files, and would send them whole through the driver."""

import pytest

from starloom.operators import funnel, ledger, spatial
from starloom.plans import catalogue

DATA = "/root/testdata/sf0.001"


def sent(df):
    return "BroadcastExchange" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["galaxy_targets", "distinct_bricks", "clearance_targets", "overlapping", "neighbours", "resolve_bricks", "propose_geometry", "resume_galaxies", "resume_backgrounds", "pending_bricks"])
def test_queries_send_no_table_through_the_driver(spark, name):
    assert not sent(catalogue.REGISTRY[name](spark, DATA))


def test_candidates_send_no_table_through_the_driver(spark):
    bricks, atlas = catalogue.v(spark, DATA, "bricks"), catalogue._atlas(spark, DATA)
    candidates = catalogue._proposed(spark, DATA)
    assert not sent(spatial.clear_of(candidates.selectExpr("id", "ra", "dec", "half_diag extra", "parent_sga_id exclude"), atlas))
    assert not sent(funnel.structural_tests(candidates, atlas, bricks))
    tested = spark.range(9).selectExpr("id parent_sga_id", "id k", "'candidate' status", "'' reason")
    assert not sent(funnel.outcome(tested, spark.range(9).selectExpr("id parent_sga_id", "id k", "'written' l_status", "'' l_reason")))
    assert not sent(ledger.pending(spark.range(9).selectExpr("id brick", "cast(id as string) name"), spark.range(5).selectExpr("cast(id as string) name")))
