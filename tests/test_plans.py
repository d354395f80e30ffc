"""Texts of postings are made once a row: copies of the expression cost time in every task and memory on the driver."""

import pytest

from hirelake.plans import registry
from hirelake.plans.all_queries import FLAGSHIP  # noqa: F401

SF = "/root/testdata/sf0.001"
#: A piece of the postings' text, which a plan holds as often as it makes the text.
PIECE = "Apply &lt;today&gt;"


@pytest.mark.parametrize("name", ["work_location_level", "select_review_cases", "review_trigger", "contradiction_links", "observation_integrity", "compact_list", "error_list", "job_fit"])
def test_a_text_is_made_once(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(PIECE) == 1


@pytest.mark.parametrize("name", ["work_location_level", "select_review_cases", "review_trigger", "contradiction_links", "observation_integrity", "compact_list", "error_list", "job_fit"])
def test_texts_are_made_after_rows_are_dealt(spark, name):
    """A condition on the text that Spark moves below the exchange is computed in as few tasks as there are input files."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert PIECE not in plan.rpartition("RepartitionByExpression")[2]  # below the lowest one
