import __spark_entry__ as entry
from moraine.plans import catalog


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_archive_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
    assert set(catalog.QUERIES) <= set(entry.queries())
