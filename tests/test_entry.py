"""The driver's contract: every SQL has its query; the flagship query and the small ones agree with DuckDB."""

import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_contract():
    assert set(E.oracle_sql()) <= set(E.queries()) and len(E.queries()) > 40


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["timestamp_clusters", "silence_gaps", "caption_lines", "job_status", "clip_iou", "transcript_coverage", "crop_geometry", "length_guard", "report_window", "cluster_in_window", "segment_edges", "first_pauses", "short_snippets", "audio_by_window", "nearest_silence"])
def test_against_sql(spark, name):
    import glob

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.sql(E.oracle_sql()[name]).df()
    got = E.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert all(((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all() for c in cols)
