import datetime as dt

from pyspark.sql import functions as F

from quarry.streaming.live import cached_stream, index_stream, rate_limit_stream, session_stream

T0 = dt.datetime(2024, 1, 1)


def stream(spark, tmp_path, name, rows, schema):
    path = f"{tmp_path}/{name}"
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/{k}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)


def drain(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.sql(f"SELECT * FROM {name}").collect()


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_rate_limit(spark, tmp_path):
    rows = [[(1, at(k)) for k in range(5)] + [(2, at(3))], [(1, at(600))]]
    s = stream(spark, tmp_path, "rate", rows, "user_id long, ts timestamp")
    out = drain(rate_limit_stream(s, most=4), "rate_out", "append")
    assert {(r["user_id"], r["n"], r["blocked"]) for r in out} == {(1, 5, True), (2, 1, False)}


def test_sessions(spark, tmp_path):
    rows = [[(1, at(0)), (1, at(60)), (1, at(7200))], [(1, at(90_000))]]
    s = stream(spark, tmp_path, "sess", rows, "user_id long, ts timestamp")
    assert sorted(r["n"] for r in drain(session_stream(s), "sess_out", "append")) == [1, 2]


def test_cache(spark, tmp_path):
    rows = [[("a", at(0)), ("a", at(1)), ("b", at(1))], [("a", at(30))]]
    s = stream(spark, tmp_path, "cache", rows, "key string, ts timestamp")
    out = drain(cached_stream(s, 10_000), "cache_out", "update")
    own = [r for r in out if r["key"] == "a"]
    assert (sum(r["hits"] for r in own), sum(r["misses"] for r in own)) == (1, 2)


def test_incremental_index(spark, tmp_path):
    rows = [[(1, "/a", "x" * 700)], [(2, "/b", "y" * 10)]]
    s = stream(spark, tmp_path, "docs", rows, "doc_id long, path string, content string")
    index_stream(s, f"{tmp_path}/chunks", f"{tmp_path}/state").awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/chunks")
    assert out.groupBy("doc_id").agg(F.count("*").alias("n")).orderBy("doc_id").collect() == [(1, 2), (2, 1)]
