import pytest

from lamella.llm import queries

CASES = [(n, queries.QUERIES[n], q) for n, q in queries.SQL.items()]


@pytest.mark.parametrize(("name", "query", "sql"), CASES, ids=[c[0] for c in CASES])
def test_same_as_sql(same_as_sql, name, query, sql):
    same_as_sql(query, sql)


def test_nothing_else_imports_this_package():
    import pathlib
    import re

    import lamella

    root = pathlib.Path(lamella.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"lamella\.llm|from \.+llm|import llm", p.read_text()), p
