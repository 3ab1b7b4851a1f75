from tidewell.plans import panel_queries


def test_an_order_of_any_status_matches_its_customer(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (3,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "O"), (2, "P"), (2, "F")], "o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    assert [r.entity for r in panel_queries.jn_anti_unmatched(spark, str(tmp_path)).collect()] == [3]
