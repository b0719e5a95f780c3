"""Driver contract smoke tests."""

import __spark_entry__ as ent


def test_entry_runs(spark):
    df = ent.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"query_id", "k", "recall", "precision", "f1", "ap"}


def test_every_oracle_has_a_query():
    assert set(ent.oracle_sql()) <= set(ent.queries())
    assert len(ent.queries()) >= 40
