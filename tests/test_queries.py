"""Every registered query against its SQL at the smallest scale; queries without SQL must return rows."""

import pytest
from compare import differences
from conftest import SF

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
MAY_BE_EMPTY = {"next_meeting", "imminent_meeting", "st_notify_due", "pending_event_lookup", "filter_jobs", "confirm_valley", "parse_document_lines"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    rows, diff = differences(spark, duck, SF, QUERIES[name], ORACLES.get(name))
    assert not diff, "\n".join(diff)
    assert rows or name in MAY_BE_EMPTY


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "chunk_id" in df.columns
