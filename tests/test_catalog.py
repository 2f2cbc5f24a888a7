"""Every registered query with SQL gives the SQL's rows; the others run and are held by other tests."""

import oracle
import pytest
from inkstream.plans import catalog, registry  # noqa: F401


@pytest.fixture(scope="module")
def duck(folder):
    return oracle.connect(folder)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, folder, duck, name):
    ours, theirs = oracle.rows_of_frame(registry.QUERIES[name](spark, folder)), oracle.rows_of_sql(duck, registry.ORACLE[name])
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_components_against_recursion(spark, folder, duck):
    from inkstream.plans.fixtures import sql

    ours = oracle.rows_of_frame(registry.QUERIES["connected_components"](spark, folder))
    assert ours == oracle.rows_of_sql(duck, sql(catalog._COMPONENTS.strip() + " SELECT image_id, y, x, CAST(label AS BIGINT) AS label FROM comp", "heat"))
