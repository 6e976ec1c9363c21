"""Every query over files against its SQL, on the smallest tables."""

import os

import pytest

from locusframe import file_queries as q
from tests.test_queries import SF, duck, plain  # noqa: F401

NAMES = sorted(n for n, f in q.QUERIES.items() if f.__module__ == q.__name__)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):  # noqa: F811
    df = q.QUERIES[name](spark, SF)
    cursor = duck.execute(q.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    found = plain([tuple(r) for r in df.collect()], df.columns)
    assert found and found == plain(cursor.fetchall(), names)
