"""Components that the second and third round join are seen."""

from thalweg.operators import paths


def test_all_rounds_are_run(spark):
    comp = {0: 1, 4: 2, 9: 3, 12: 4}
    weight = {c: 5.0 for c in (1, 2, 3)} | {c: 9.0 for c in (5, 6, 7, 8)}
    rows = [(7, 0, c, 10, weight.get(c, 0.0), 1.0 if c in comp else 0.0 if c > 9 else 0.3, comp.get(c, -1), 1, c == 0, c in comp) for c in range(13)]
    cells = spark.createDataFrame(rows, "basin_id long, r int, c int, elev int, weight double, prob double, comp int, main int, is_ref boolean, low boolean")
    left = lambda *cutoffs: {r.comp for r in paths.unseen_components(cells, *cutoffs).collect()}
    assert left((8.0,)) == {2, 3, 4} and left((8.0, 32.0)) == {3, 4} and left() == {4}
