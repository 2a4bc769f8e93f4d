"""Every registered query against its SQL, whole results, and the shape of every plan."""

import pytest

import __spark_entry__ as entry_module
from checks.compare import differences
from checks.oracle import all_oracles
from checks.queries import all_queries

QUERIES, ORACLES = all_queries(), all_oracles()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_matches_sql(name, spark, duck, sf_dir):
    result = QUERIES[name](spark, sf_dir)
    plan = result._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEval"):
        assert operator not in plan
    assert differences(result, duck, ORACLES[name]) == []


def test_entry(spark, sf_dir):
    result = entry_module.entry(spark)
    assert result.columns == ["Anio_mes", "Ingresos", "Margen", "Mg_pct", "Descuento"]
    assert result.count() == 80
