"""Numbers and links inside basins against plain loops."""

import random

from thalweg.operators import merge


def test_links_inside_basins(spark):
    """Basins larger than a batch, targets and sources that are not there, with and without given sources."""
    rng, rows, seg = random.Random(3), [], {}
    for basin in range(-3, 30):
        n = rng.choice((1, 2, 3, 40))
        ids = sorted(rng.sample(range(60), n))
        rows += [(basin, i, rng.choice([*ids, -1, 61, None])) for i in ids]
    for k, (basin, i, _) in enumerate(rows):
        seg[basin, i] = k
    given = {(b, i): rng.sample(range(62), rng.choice((0, 1, 2))) for b, i, _ in rows}
    schema = "basin_id long, local_id int, local_target int"
    mixed = rng.sample(rows, len(rows))
    own = spark.createDataFrame(mixed, schema).repartition(5)
    with_given = spark.createDataFrame([(*r, given[r[:2]]) for r in mixed], schema + ", local_sources array<int>").repartition(5)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, 7)
        got = {(r.basin_id, r.local_id): r for r in merge.numbered_links(own).collect()}
        also = {(r.basin_id, r.local_id): r for r in merge.numbered_links(with_given).collect()}
    finally:
        spark.conf.set(name, before)
    assert len(got) == len(also) == len(rows)
    for b, i, target in rows:
        for found in (got[b, i], also[b, i]):
            assert found.seg_id == seg[b, i] and found.inner_target == seg.get((b, target))
        assert got[b, i].local_sources == [seg[x, j] for x, j, t in rows if x == b and t == i]
        assert also[b, i].local_sources == [seg.get((b, j), -1) for j in given[b, i]]
    assert merge.numbered_links(own.limit(0)).count() == 0


def test_merge_needs_no_sources(spark):
    from thalweg.sources.bridge import VIEWS

    spark.range(60).selectExpr("id AS o_orderkey", "id * 7 AS o_custkey").createOrReplaceTempView("orders")
    spark.sql(VIEWS["b_streams"]).createOrReplaceTempView("b_streams")
    segments = spark.sql(VIEWS["b_segments"])
    plain, given = (sorted(map(tuple, merge.merge_network(x).collect())) for x in (segments, merge.with_sources(segments)))
    assert plain == given and len(plain) == segments.count()
