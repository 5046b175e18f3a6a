"""Native operators run no Python on the executors, in plans of all jobs that they start."""

import pytest

from siftwork.llm import mixing, queries


@pytest.mark.parametrize("name", ["op2_quality_rules", "op8_source_mix", "op10_secret_scan"])
def test_native(spark, data, name):
    text = queries.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in text for w in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_native_rounds(spark):
    items = spark.range(500).selectExpr("'s' source", "id row", "id % 7 + 1 size", "0.4 p")
    text = mixing._level(items, 1.25, 0)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Window" not in text
