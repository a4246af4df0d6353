"""Work of many steps a row is dealt out whatever the number of files, and is done once."""

import pytest

from corpusflow.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["summary_spine", "review_records"])
def test_small_files_are_dealt_out(spark, name):
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 32, true" in plan


def test_lines_of_a_summary_are_split_once(spark):
    """A spine's fences and the fences of what is counted: each is cut in one place."""
    plan = catalogue.queries()["summary_spine"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?= *```)") == 2
