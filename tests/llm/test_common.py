from shardloom.llm._common import range_bounds, range_bucket


def test_range_buckets(spark):
    ids = [*range(0, 3000, 3), -5, 2**62, -(2**62)]
    frame = spark.createDataFrame([(i,) for i in ids] + [(None,)], "doc_id long")
    bounds = range_bounds(frame, "doc_id", 37)
    assert 30 <= len(bounds) <= 36
    for r in frame.select("doc_id", range_bucket("doc_id", bounds).alias("b")).collect():
        assert r.b == (0 if r.doc_id is None else sum(x <= r.doc_id for x in bounds))
    assert range_bounds(frame.where("doc_id = 1"), "doc_id", 5) == [] == range_bounds(frame, "doc_id", 1)
