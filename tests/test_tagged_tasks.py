"""Tagged references are labelled by many tasks, also where their table is one small file."""

import pytest

from paperloom.plans import supervision_queries as Q


@pytest.mark.parametrize("scheme", ["cora", "umass", "kermit"])
def test_rows_are_spread(spark, sf_dir, scheme):
    assert "Exchange RoundRobinPartitioning(" in Q.QUERIES[f"tagged_{scheme}"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
