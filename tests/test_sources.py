import pytest
from pyspark.sql import functions as F

from chromill import schemas
from chromill.sources import files, sinks
from chromill.streaming import resume


def test_csv_scans(spark, tmp_path):
    (tmp_path / "p.csv").write_text(',red\ncluster_0,"0.5"\n')
    got = files.read_csv(spark, str(tmp_path / "p.csv"), schemas.T.StructType([schemas.T.StructField("red", schemas.T.DoubleType())]), index="cluster").first()
    assert tuple(got) == ("cluster_0", 0.5)
    (tmp_path / "q.csv").write_text("filename,other\na,b\n")
    with pytest.raises(ValueError, match="page"):
        files.read_pages(spark, str(tmp_path / "q.csv"))
    assert files.processed(spark, str(tmp_path / "none.csv")).count() == 0
    assert files.palette(spark).count() == 12


def test_batches_first_wins(spark, tmp_path):
    (tmp_path / "batch_001.csv").write_text("url,red\na,1\nb,2\n")
    (tmp_path / "batch_002.csv").write_text("url,red\na,9\nc,3\n" + "".join(f"d,{i}\n" for i in range(500)) + "c,4\n")
    got = files.read_batches(spark, str(tmp_path), schemas.T.StructType([schemas.T.StructField("url", schemas.T.StringType()), schemas.T.StructField("red", schemas.T.DoubleType())]))
    assert sorted(map(tuple, got.collect())) == [("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", 0.0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, batch int")
    out = str(tmp_path / "o")
    sinks.write_incremental(df, out)
    sinks.write_incremental(df, out)
    assert spark.read.option("header", True).csv(out).count() == 4
    sinks.write_incremental(df, out, resume=False)
    assert spark.read.option("header", True).csv(out).count() == 2
    backup = sinks.rewrite_with_backup(spark.read.option("header", True).csv(out).where("k = 'a'"), out)
    assert spark.read.option("header", True).csv(out).count() == 1 and spark.read.option("header", True).csv(backup).count() == 2
    b = str(tmp_path / "b")
    keyed = df.withColumnRenamed("k", "url")
    sinks.write_batches(keyed, b)
    sinks.write_batches(keyed.where("batch = 2").withColumn("url", F.lit("z, z")), b)
    schema = schemas.T.StructType([schemas.T.StructField("url", schemas.T.StringType()), schemas.T.StructField("batch", schemas.T.IntegerType())])
    assert sorted(map(tuple, files.read_batches(spark, b, schema).collect())) == [("a", 1), ("z, z", 2)]
    sinks.write_report(spark, "x\ny", str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() == 2
    sinks.write_images(spark.createDataFrame([("a", bytearray(b"xy"))], "filename string, content binary"), str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).first().length == 2


def test_listings(spark, tmp_path):
    (tmp_path / "l.html").write_text('<a href="/p1"><div style="background-image: url(&quot;i.jpg&quot;);"></div></a>\n<a class="x" href="/p2?a=1&amp;b=2">\n<div style="background-image: none"></div></a>')
    (tmp_path / "m.html").write_text("<p>no tiles</p>")
    got = files.read_listings(spark, f"{tmp_path}/*.html", "red")
    assert sorted(map(tuple, got.collect())) == [("/p1", 'url("i.jpg")', "red"), ("/p2?a=1&b=2", "none", "red")]


def test_stream_resumes(spark, tmp_path):
    src, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    src.mkdir()
    (src / "1.csv").write_text("filename,page\na,x\nb,y\n")
    run = lambda: resume.process_new(spark, str(src), schemas.ART_PAGES, lambda d: d.withColumn("status", F.lit("ok")), out, mark)
    assert run() == 2 and run() == 2
    (src / "2.csv").write_text("filename,page\nc,z\n")
    assert run() == 3
    results = spark.createDataFrame([("a", "error"), ("a", "ok"), ("b", "error")], "filename string, status string")
    assert [r.filename for r in resume.later(results).collect()] == ["b"]


def test_backoff_state_in_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.csv").write_text("h,1,200\nh,2,429\nh,3,429\n")
    stream = spark.readStream.schema("host string, at long, status int").csv(str(src))
    seen = []
    q = resume.backoff_stream(stream).writeStream.outputMode("update").foreachBatch(lambda d, _: seen.extend(map(tuple, d.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == [("h", 3, pytest.approx(0.9 * 1.5 * 1.5))]
