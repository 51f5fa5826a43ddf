"""The largest order of every basin, with the unmatched sides of the join."""

from thalweg import catalog
from thalweg.operators import merge
from thalweg.sources.bridge import load

SF = "/root/testdata/sf0.001"


def test_both_sides_stay(spark):
    segments = spark.createDataFrame([(5, 1), (5, 3), (6, 2), (8, 4)], "basin_id long, seg_order int")
    streams = spark.createDataFrame([(5, 6), (6, -1), (7, 6)], "stream_id long, target_id long")
    assert sorted(map(tuple, merge.basin_max_orders(segments, streams).collect())) == [(5, 3, 6), (6, 2, -1), (7, None, 6), (8, 4, None)]


def test_every_fifth_basin_has_its_order(spark):
    most = {r.stream_id: r.max_order for r in catalog.QUERIES["basin_max_order"](spark, SF).collect()}
    own = {}
    for r in load(spark, SF, "b_segments").select("basin_id", "seg_order").collect():
        own[r.basin_id] = max(own.get(r.basin_id, 0), r.seg_order)
    assert any(k % 5 == 0 for k in own) and {k: most[k] for k in own} == own
