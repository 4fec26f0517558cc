from gleaner.operators.index import Index
from gleaner.plans.search import Searcher
from gleaner.streaming.search import search_stream


def test_stream_of_queries(spark, tmp_path):
    index = Index.build(spark.createDataFrame([(1, "apple pie"), (2, "cherry tart")], "doc_id long, text string"))
    spark.createDataFrame([(1, "apple"), (2, "cherry tart")], "qid long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid long, text string").parquet(str(tmp_path / "in"))
    query = search_stream(Searcher(index), stream, str(tmp_path / "out"), str(tmp_path / "check"), 3, suggest=False)
    query.processAllAvailable()
    query.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.qid, r.doc_id) for r in got.collect()} == {(1, 1), (2, 2)}
