import datetime
import glob
import os
import sys
from collections import Counter

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lamella.session import session  # noqa: E402

DATA = os.environ.get("LAMELLA_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def bag(rows, columns, order):
    at = [columns.index(c) for c in order]
    return Counter(tuple(plain(r[i]) for i in at) for r in rows)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    """Compare a query with its SQL, as bags of rows."""

    def check(query, sql):
        df = query(spark, DATA)
        order = sorted(df.columns)
        result = duck.execute(sql)
        names = [c[0] for c in result.description]
        assert sorted(names) == order
        assert bag(df.collect(), df.columns, order) == bag(result.fetchall(), names, order)

    return check
