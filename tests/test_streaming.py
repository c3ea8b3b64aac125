import datetime as dt

from pyspark.sql import functions as F

from plexgraph.streaming import debounce

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "key string, ts timestamp, sha string"


def written(spark, path, rows):
    d = spark.createDataFrame([(k, T0 + dt.timedelta(seconds=s), h) for k, s, h in rows], SCHEMA)
    d.coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_sessions_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    written(spark, path, [("a", 0, "1"), ("a", 10, "2"), ("a", 100, "3"), ("b", 5, "1"), ("z", 5000, "9")])
    out = debounce.quiet_sessions(stream(spark, path))
    q = out.writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["key"], r["n"]) for r in spark.table("quiet").where("key <> 'z'").collect()}
    want = {(r["key"], r["n"]) for r in debounce.quiet_sessions(spark.read.parquet(path)).where("key <> 'z'").collect()}
    assert got == want == {("a", 2), ("a", 1), ("b", 1)}


def test_quiet_keys_ceiling_and_clean_content(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    busy = [("busy", s, str(s)) for s in range(0, 700, 20)]
    written(spark, path, [("a", 0, "x"), ("a", 5, "y"), *busy])
    written(spark, path, [("a", 1000, "y"), ("tick", 1000, "t")])
    written(spark, path, [("tick", 5000, "u")])
    written(spark, path, [("tick", 9000, "v")])
    out = debounce.ready(stream(spark, path))
    q = out.writeStream.format("memory").queryName("ready").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.table("ready").collect()
    a = [(r["sha"], r["why"]) for r in rows if r["key"] == "a"]
    assert a == [("y", "quiet")]  # the later change left the content as it was
    assert ("ceiling") in {r["why"] for r in rows if r["key"] == "busy"}


def test_watch_hands_over_distinct_keys(spark, tmp_path):
    path, seen = f"file://{tmp_path}/in", []
    written(spark, path, [("a", 0, "x"), ("a", 1, "y")])
    written(spark, path, [("b", 2, "z")])
    debounce.watch(stream(spark, path), lambda d, n: seen.append(sorted((r["key"], r["sha"]) for r in d.collect())), f"{tmp_path}/c", once=True).awaitTermination(120)
    assert sorted(sum(seen, [])) == [("a", "y"), ("b", "z")]
    assert F is not None
