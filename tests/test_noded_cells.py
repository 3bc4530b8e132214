from waymark.operators import arrangement


def test_cells_follow_the_pieces_of_cut_edges(spark):
    strips = [(0, i * 100, 4000, i * 100, 1, 0) for i in range(40)] + [(i * 100 + 7, -50, i * 100 + 7, 3950, 1, 0) for i in range(40)]
    edges = spark.createDataFrame([(0, *s) for s in strips], "k int, ax long, ay long, bx long, by long, da long, db long")
    out, cell = arrangement.noded(edges, ["k"])
    assert out.count() == 40 * 41 * 2 and cell < 400
