import pytest

from lodestack.plans import registry

from .conftest import SF


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(name, same_as_sql):
    same_as_sql(registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(name, spark):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry_module(spark):
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark, capsys):
    registry.consented_events(spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    registry.genre_trends(spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan and "Cartesian" not in plan
