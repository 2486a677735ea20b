from lexforge.operators.index import postings
from lexforge.streaming.postings import index_stream, read_index


def test_shards_are_indexed_as_they_arrive(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, f"אב {w}", "גד") for i, w in enumerate(("אחד", "שתים", "שלש"))]
    df = spark.createDataFrame(rows, "rec_id bigint, dh string, t string")
    for part in (df.where("rec_id < 2"), df.where("rec_id = 2")):
        part.write.mode("append").parquet(src)
        index_stream(spark.readStream.schema(df.schema).parquet(src), "rec_id", ("dh", "t"), out, str(tmp_path / "cp")).awaitTermination()
    want = {tuple(r) for r in postings(df, "rec_id", ("dh", "t")).collect()}
    got = [tuple(r) for r in read_index(spark, out, "rec_id").drop("batch").collect()]
    assert len(got) == len(want) and set(got) == want


def test_a_reloaded_record_replaces_its_earlier_load(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "rec_id bigint, dh string, t string"
    for rows in ([(1, "אב", "גד"), (2, "הו", ""), (3, "זח", "")], [(1, "אב", "יכ")], [(3, "", None)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        index_stream(spark.readStream.schema(schema).parquet(src), "rec_id", ("dh", "t"), out, str(tmp_path / "cp")).awaitTermination()
    got = sorted((r.rec_id, r.token) for r in read_index(spark, out, "rec_id").collect())
    assert got == [(1, "אב"), (1, "יכ"), (2, "הו")]
