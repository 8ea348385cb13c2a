"""Every query with SQL gives the rows of its SQL; the others give rows."""

import pytest
from compare import differences, oracle
from framesift.plans.oracle import ORACLE_SQL
from framesift.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
#: Their SQL joins all pairs of a sequence's frames, which is slow; one of them stands for the others here.
SLOW = {"cascade_keyframes", "cascade_reasons", "prev_keyframe_links", "keyframe_filter", "task_summary", "global_summary", "ocr_redaction", "stream_cascade"}


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - SLOW))
def test_query(spark, name):
    assert differences(QUERIES[name](spark, SF).toPandas(), oracle(SF, ORACLE_SQL[name])) == []


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 500


def test_all_frames_are_written_and_scanned(spark):
    """Of every label, not of the first alone."""
    got = QUERIES["image_scan_all"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()
