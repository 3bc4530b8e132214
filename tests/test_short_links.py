from waymark.plans.catalogue import QUERIES


def test_states_on_the_grid_come_back_equal(spark, tmp_path):
    rows = [(k, "s") for k in (11036, 20411, 23536, 24512, 29007, 30959, 4096000)]
    spark.createDataFrame(rows, "doc_id long, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["short_links"](spark, str(tmp_path)).select("same").collect()
    assert len(got) == len(rows) and all(r["same"] for r in got)
