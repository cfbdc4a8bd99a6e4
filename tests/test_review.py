from triweave.operators import review


def test_nulls_last_both_ways(spark):
    df = spark.createDataFrame([("b",), (None,), ("A",)], "x string")
    assert [r.x for r in review.sort_review(df, "x").collect()] == ["A", "b", None]
    assert [r.x for r in review.sort_review(df, "x", True).collect()] == ["b", "A", None]


def test_null_status_is_not_missing(spark):
    feed = spark.createDataFrame([('{"status":"SUCCESS","data":[{"documentId":1,"accounting":null},{"documentId":2},{"documentId":3,"accounting":true}]}',)], "json string")
    status = review.read_status(feed)
    assert sorted(map(tuple, status.collect()), key=str) == [(1, None), (3, True)]
    cached = spark.createDataFrame([(1, True), (9, False)], "document_id long, accounting boolean")
    both = review.overlay_status(cached, status)
    assert {r.document_id: r.accounting for r in both.collect()} == {1: None, 3: True, 9: False}
    asked = spark.createDataFrame([(1,), (1,), (2,), (3,)], "document_id long")
    assert [r.document_id for r in review.unmarked(asked, status).collect()] == [1]
