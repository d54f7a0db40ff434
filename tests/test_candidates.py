"""Candidates with texts: a query's tokens are made once, not for each candidate, and texts of others stay where they are."""

import pytest

from corpusmill import plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["rerank", "rank_movement"])
def test_tokens_of_a_query_are_made_before_the_join(spark, name):
    plan = plans.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct(") == 1 and "LeftSemi" in plan


def test_cited_parts_are_cut_before_the_join(spark):
    lines = plans.queries()["answer_deterministic"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    cut, semi = (next(i for i, line in enumerate(lines) if word in line) for word in ("substring(text", "LeftSemi"))
    assert cut > min(i for i, line in enumerate(lines) if "Join Inner" in line) and semi
