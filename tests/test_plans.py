"""Plans that matter at scale."""

from pyspark.sql import functions as F

from matricula.operators import registry, review, scoring
from matricula.plans import adapters as A
from tests.conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_visible_children_is_a_semi_join(spark):
    assert "LeftSemi" in plan(registry.visible_children(A.validation_issue(spark, SF), A.requirement_set(spark, SF)))


def test_pending_takes_the_top_without_a_full_sort(spark):
    waiting = A.requirement_set(spark, SF).orderBy(F.desc("confidence"), "id").limit(20)
    assert "TakeOrderedAndProject" in plan(waiting)
    assert "TakeOrderedAndProject" in plan(review.pending(A.requirement_set(spark, SF), A.validation_issue(spark, SF), A.track(spark, SF), A.program(spark, SF), A.institution(spark, SF)))


def test_cap_limits_groups_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(scoring.cap_per_group(A.grant(spark, SF), "author_id", 5, F.desc("start_date"), F.asc("grant_id")))


def test_scans_read_only_what_they_need(spark):
    text = plan(review.status_counts(A.requirement_set(spark, SF)))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text
