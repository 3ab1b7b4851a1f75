from tidewell.llm import decontaminate


def test_rows_that_repeat_an_id_stay_apart_with_blocks_of_items(spark, monkeypatch):
    rows = [(1, "same"), (1, "x y z"), (1, "a b same"), (1, "same"), (2, None), (None, "a b"), (None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(1, "Same"), (3, "word " * 13), (4, "a b")], "item_id long, text string")
    order = lambda df: sorted(df.collect(), key=str)
    whole = order(decontaminate.report(docs, items))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 3)
    assert len(whole) == len(rows) and order(decontaminate.report(docs, items)) == whole
