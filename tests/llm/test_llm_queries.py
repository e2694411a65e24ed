import pytest
from compare import connect, difference
from samples import SMALL

import __spark_entry__ as entry
from tillcast.llm.queries import QUERIES, SQL


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert difference(got, connect(SMALL).execute(SQL[name]).df()) is None
