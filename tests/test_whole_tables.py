"""Queries over whole tables leave no row out."""

from cairn import catalog

SF = "/root/testdata/sf0.001"


def test_every_match_and_triangle_counts(spark):
    run = lambda name: catalog.queries()[name](spark, SF).collect()
    rows, points = (spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("lineitem", "orders"))
    per_camera = run("match_heatmap_whole")
    assert sum(q.matches for q in per_camera) == rows
    assert max(q.most for q in run("match_grid_heatmap_whole")) == max(q.matches for q in per_camera) == run("best_match_whole")[0].matches
    assert len(run("top_labels_whole")) == 5
    assert run("mesh_area_whole")[0].triangles == points - 2
    assert len(run("mesh_clusters_whole")) == points


def test_canopy_cover_at_the_spacing_of_the_reference(spark):
    nodes = sum((i - 50) ** 2 + (j - 50) ** 2 <= 2500 for i in range(101) for j in range(101))
    assert {q.total for q in catalog.queries()["canopy_cover_fine"](spark, SF).collect()} == {nodes}
