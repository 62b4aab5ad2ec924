"""Plans keep their shape: no Cartesian products, filters and columns reach the scan."""

from cartolith.plans import registry

DATA = "/root/testdata/sf0.001"


def plan(spark, name):
    frame = registry.queries()[name](spark, DATA)
    return frame._jdf.queryExecution().executedPlan().toString()


def test_spatial_joins_are_equi_joins(spark):
    for name in ("JOIN_08_spatial_bounds_join", "JOIN_20_nearest_segment", "JOIN_23_nearest_pole"):
        text = plan(spark, name)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "SRC_05_feature_source")
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in text and "o_comment" not in text


def test_overlay_aggregates_before_the_shuffle(spark):
    assert "partial_min_by" in plan(spark, "WIN_01_first_writer_overlay")
