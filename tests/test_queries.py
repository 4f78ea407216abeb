import os

import pytest

import __spark_entry__ as entry
from redpen.sources import sinks

TINY = "/root/testdata/sf0.001"


def test_every_query_is_named_and_checked():
    names, sql = set(entry.queries()), set(entry.oracle_sql())
    assert sql <= names
    assert {n for n in names - sql if not n.startswith("op") and n != "pipeline"} == set()


@pytest.mark.skipif(not os.path.isdir(TINY), reason="test tables are not here")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"offset", "length", "replacement"} <= set(df.columns)


@pytest.mark.skipif(not os.path.isdir(TINY), reason="test tables are not here")
def test_stream_equals_batch(spark):
    q = entry.queries()
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "sent_idx", "offset", "length", "replacement").collect())
    assert key(q["t1_stream_check"](spark, TINY)) == key(q["main_check_no_reuse"](spark, TINY))


def test_shared_folder_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    first, second = sinks.shared_folder(spark, "x"), sinks.shared_folder(spark, "x")
    assert first != second
    if named:
        assert first.startswith(named)
