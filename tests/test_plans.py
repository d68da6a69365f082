"""What the plans must look like, whatever the size: pruned scans, early cuts, no products of rows."""

import io
import os
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("CORPUSLOOM_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data here")


def plan(spark, name):
    out = io.StringIO()
    with redirect_stdout(out):
        entry.queries()[name](spark, DATA).explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize(
    ("name", "columns"),
    [("t_fold", "doc_id:bigint,text:string"), ("t_location", "id:string,metadata:struct<source_type:string,page:int,source_url:string>"), ("c_noise_lines", "id:string,text:string"), ("k_hourly_events", "ts:timestamp_ntz,event_type:string,value:double"), ("r_bm25", "doc_id:bigint,text:string")],
)
def test_scans_read_only_what_is_used(spark, name, columns):
    text = plan(spark, name)
    assert f"struct<{columns}" in text
    assert "recebido_em" not in text and "extraido_em" not in text


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(text)]" in plan(spark, "t_tokens")


@pytest.mark.parametrize("name", ["r_cap_select", "r_bm25", "r_dense_top"])
def test_ranked_cuts_come_early(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


@pytest.mark.parametrize("name", ["b_containment", "b_neighbours", "j_nearest", "x_duplicate_tables", "a_pair_agreement", "b_reanchor", "h_repeated_blocks"])
def test_no_products_of_rows(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["t_fold", "c_page_signals", "g_sliding_chunks", "m_graded", "b_containment"])
def test_hot_paths_stay_out_of_python(spark, name):
    text = plan(spark, name).replace("MapInArrow", "") if name == "m_graded" else plan(spark, name)
    assert "Python" not in text and "ArrowEval" not in text
