import pytest

import __spark_entry__ as entry
from compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
TRAINING = {"oof_predictions", "backtest", "select_top_features", "score_month"}
# A search of fifty draws; test_jobs runs a smaller one.
LONG = {"random_search"}


def test_every_sql_has_a_query():
    assert set(entry.own_sql()) <= set(entry.own_queries())
    assert set(entry.own_queries()) - set(entry.own_sql()) == TRAINING


@pytest.mark.parametrize("name", [n for n in entry.own_queries() if n not in TRAINING | LONG])
def test_query_equals_sql(spark, name):
    got = entry.own_queries()[name](spark, FOLDER).toPandas()
    want = connect(FOLDER).execute(entry.own_sql()[name]).df()
    assert difference(got, want) is None


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
