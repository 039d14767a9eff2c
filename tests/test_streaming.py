import datetime as dt

from quillspark.streaming import live


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_scores_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("The cat sat on the mat.\n\nDas ist ein Haus und nicht mehr.\n")
    run(live.score_stream(live.line_stream(spark, str(tmp_path / "in"))), "scored")
    rows = spark.sql("select language, metric from scored").collect()
    assert {r.language for r in rows} == {"en", "de"} and ("en", "flesch") in {(r.language, r.metric) for r in rows}


def test_windows_and_first_seen(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, "a", 1.0), (t + dt.timedelta(minutes=5), "a", 2.0), (t + dt.timedelta(hours=9), "b", 4.0)], "ts timestamp, k string, value double")
    df.write.parquet(str(tmp_path / "e"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    run(live.windowed(stream(), "ts", "k"), "windowed", "complete")
    assert {(r.k, r.events, r.total) for r in spark.sql("select * from windowed").collect()} == {("a", 2, 3.0), ("b", 1, 4.0)}
    run(live.first_seen(stream(), ["k"], "ts"), "firsts")
    assert spark.sql("select * from firsts").count() == 2
