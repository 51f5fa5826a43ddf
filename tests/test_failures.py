"""Basins that break a kernel, and runs that are killed halfway."""

import pytest
from pyspark.sql import functions as F

from thalweg import catalog
from thalweg.operators import components, lines, network, paths, skeleton, snapping
from thalweg.operators.guard import Failures
from thalweg.plans import basins

SF = "/root/testdata/sf0.001"
BASINS, BAD = (2, 5, 7, 11), 5


@pytest.fixture(scope="module")
def held(spark):
    """A few basins; the cells of the bad one lie in rows below -20, by which the broken kernels know it."""
    pick = lambda df, c: df.filter(F.col(c).isin(*BASINS))
    down = lambda df: df.withColumns({r: F.when(F.col("basin_id") == BAD, F.col(r) - 60).otherwise(F.col(r)).cast("int") for r in ("r", "to_r") if r in df.columns})
    cells, streams, flow = (catalog.load(spark, SF, "b_cells_masked"), catalog.load(spark, SF, "b_streams"), catalog.reference(spark, SF))
    ids = sorted(r.basin_id for r in cells.select("basin_id").distinct().collect())[: len(BASINS)]
    number = F.element_at(F.create_map(*(F.lit(x) for pair in zip(ids, BASINS) for x in pair)), F.col("basin_id")).cast("long")
    own = lambda df: down(df.filter(F.col("basin_id").isin(ids)).withColumn("basin_id", number))
    links = spark.createDataFrame([(b, -1, 2, -1, -1) for b in BASINS], "stream_id long, target_id long, base_order int, us1 long, us2 long")
    return own(cells).cache(), links, own(flow).cache()


def broken(module, name, is_bad, error):
    real = getattr(module, name)

    def run(*args):
        if is_bad(*args):
            raise error("on purpose")
        return real(*args)

    return run


KERNELS = {
    "label": (components, "component_labels", lambda r, c, kind: r.min() < -20),
    "connect": (paths, "rounds", lambda basin, cutoffs: basin["r"].min() < -20),
    "thin": (skeleton, "thin_cells", lambda cells: min(r for r, _ in cells) < -20),
    "trace": (lines, "trace_cells", lambda cells: min(r for r, _ in cells) < -20),
    "snap": (snapping, "grow", lambda edges, starts: min(y for _, y in starts) < -20),
    "segments": (network, "segments_of", lambda targets, from_ref, own: min(targets) < 0),
}


@pytest.mark.parametrize("stage", KERNELS)
@pytest.mark.parametrize("error", [ValueError, IndexError])
def test_a_basin_that_breaks_any_kernel_is_named_once(spark, held, stage, error, tmp_path, monkeypatch):
    if error is IndexError and stage != "thin":
        pytest.skip("one kernel shows what an index error does")
    module, name, is_bad = KERNELS[stage]
    monkeypatch.setattr(module, name, broken(module, name, is_bad, error))
    out = basins.vector_network(*held, quarantine=str(tmp_path / "q")).collect()
    failed = spark.read.parquet(str(tmp_path / "q")).collect()
    assert [(r.basin_id, r.stage, r.error_kind) for r in failed] == [(BAD, stage, error.__name__)] and "on purpose" in failed[0].error
    bad = [r for r in out if r.basin_id == BAD]
    assert {r.basin_id for r in out} >= set(BASINS) - {BAD}
    if error is IndexError:  # the trusted stream stands in
        assert len(bad) == 1 and bad[0].line is None and bad[0].stream_order == 2
    else:
        assert not bad


def test_without_a_note_of_failures_the_job_ends(held, monkeypatch):
    monkeypatch.setattr(components, "component_labels", broken(*KERNELS["label"], ValueError))
    with pytest.raises(Exception, match="on purpose"):
        basins.basin_segments(held[0], held[2]).count()


def test_failures_of_no_run(spark):
    assert Failures().found(spark).count() == 0


def test_a_killed_run_is_taken_up_where_it_stopped(spark, held, tmp_path, monkeypatch):
    cells, streams, flow = held
    regions = spark.createDataFrame([(2, 1), (5, 2), (7, 2), (11, 3)], "basin_id long, region_id long")
    fields = lambda rows: sorted((r.basin_id, r.stream_id, r.target_stream_id, tuple(r.source_stream_ids), r.stream_order, r.from_ref, bytes(r.line or b"")) for r in rows)
    want = fields(basins.vector_network(cells, streams, flow).collect())
    whole, asked = basins.write_segments, []

    def killed(segments, path, *rest):
        whole(segments, path, *rest)
        if path.endswith("segments"):
            asked.append(sorted(r.region_id for r in segments.select("region_id").distinct().collect()))
            if len(asked) == 2:
                raise KeyboardInterrupt  # after the second region's segments, before it is named as done

    monkeypatch.setattr(basins, "write_segments", killed)
    with pytest.raises(KeyboardInterrupt):
        basins.resumed_network(cells, streams, flow, regions, str(tmp_path / "run"), at_once=1)
    assert [r.region_id for r in spark.read.parquet(str(tmp_path / "run" / "done")).collect()] == [1]
    got = fields(basins.resumed_network(cells, streams, flow, regions, str(tmp_path / "run"), at_once=1).collect())
    assert got == want and asked[:3] == [[1], [2], [2]] and len(asked) == 4
    again = fields(basins.resumed_network(cells, streams, flow, regions, str(tmp_path / "run"), at_once=1).collect())
    assert again == want and len(asked) == 4  # nothing was left to do
    monkeypatch.setattr(basins, "write_segments", whole)
    assert fields(basins.resumed_network(cells, streams, flow, regions, str(tmp_path / "run"), overwrite=True).collect()) == want
