import pytest

from lamella.plans import general, store

CASES = [(n, q, m.SQL[n]) for m in (general, store) for n, q in m.QUERIES.items() if n in m.SQL]


@pytest.mark.parametrize(("name", "query", "sql"), CASES, ids=[c[0] for c in CASES])
def test_same_as_sql(same_as_sql, name, query, sql):
    same_as_sql(query, sql)


def test_every_sql_has_a_query():
    for m in (general, store):
        assert set(m.SQL) <= set(m.QUERIES)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["image", "tag", "digest", "valid_from", "valid_to"]
    assert set(e.oracle_sql()) <= set(e.queries())
