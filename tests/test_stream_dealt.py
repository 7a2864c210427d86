"""A small table in one file is analysed on all cores by the stream too."""

from provenir.streaming import stream


def test_one_file_is_dealt_to_all_cores(spark, tmp_path):
    d = spark.createDataFrame([(i, f"the text {i} and no more") for i in range(200)], "doc_id long, text string")
    d.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    out = stream.analyzed_stream(spark, str(tmp_path / "documents.parquet"), d.schema)
    assert out.count() == out.select("doc_id").distinct().count() == 200
    assert len(out.inputFiles()) == min(200, spark.sparkContext.defaultParallelism) > 1
