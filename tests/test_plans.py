"""Plans are the ones wanted: pruned and filtered scans, no pairing of all with all, bounded top-k windows."""

import pytest

from shutterloom.plans import fold_queries, ranking_queries, relational_queries, report_queries, scalar_queries, table_queries  # noqa: F401
from shutterloom.plans.registry import QUERIES

PYTHON = ("Python", "Pandas", "Arrow")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["f01_similar_pairs", "j05_roster_lookup", "j06_multi_key_lookup", "j08_absent", "j12_guides_in_frames", "j13_nearest_group", "j15_regroup", "j20_error_tags", "a18_error_queue", "k13_manifest", "s25_roster_format_a", "h24_resolved_files"])
def test_no_join_of_all_with_all(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_segments_need_no_join(spark, sf):
    text = plan(QUERIES["j11_segments"](spark, sf))
    assert "Join" not in text and "Window" in text


def test_top_k_is_limited_before_the_shuffle(spark, sf):
    for name in ("o13_candidates", "j25_top_similar"):
        assert "WindowGroupLimit" in plan(QUERIES[name](spark, sf))


def test_scans_are_pruned_and_filtered(spark, sf):
    text = plan(QUERIES["j24_keyword_search"](spark, sf))
    assert "PushedFilters" in text and "EqualTo(source,src3)" in text and "lang" not in text
    text = plan(QUERIES["snap_buckets"](spark, sf))
    assert "p_name" not in text and "p_type" not in text


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n[:3] in ("x01", "x13", "x36", "x50", "p04", "p13", "p19", "w03", "a04", "a06", "j03")))
def test_columns_stay_in_the_engine(spark, sf, name):
    assert not any(p in plan(QUERIES[name](spark, sf)) for p in PYTHON)


def test_buckets_shuffle_once(spark, sf):
    assert plan(QUERIES["snap_buckets"](spark, sf)).count("Exchange hashpartitioning") == 1
