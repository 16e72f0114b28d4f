from datetime import datetime, timedelta

from quirestone.streaming.ingest import counts_by_window, document_stream, first_deliveries, index_stream, sessions

T = datetime(2024, 1, 1)


def test_each_content_is_indexed_once(spark, tmp_path):
    rows = [(1, "a  b", T), (2, "a b", T + timedelta(hours=1)), (3, "c", T)]
    spark.createDataFrame(rows, "id int, text string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = document_stream(spark, str(tmp_path / "in"), "id int, text string, at timestamp")
    write = lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={n}"))
    for again in range(2):
        index_stream(first_deliveries(stream, text="text", at="at"), write=write, checkpoint=str(tmp_path / "cp")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(out) == 2 and {r.id for r in out} in ({1, 3}, {2, 3})


def collected(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "windows" else "append").start()
    q.processAllAvailable()
    q.stop()
    return [tuple(r) for r in df.sparkSession.table(name).collect()]


def test_windows_and_sessions(spark, tmp_path):
    minutes = [0, 10, 50, 61, 200, 5000]
    spark.createDataFrame([(T + timedelta(minutes=m), "u", "click") for m in minutes], "ts timestamp, user string, kind string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = document_stream(spark, str(tmp_path / "in"), "ts timestamp, user string, kind string")
    got = collected(counts_by_window(stream, at="ts", by=["kind"]), "windows")
    assert sorted(n for *_, n in got) == [1, 1, 1, 3]
    done = collected(sessions(stream, at="ts", user="user", late="1 minute"), "ended")
    assert sorted(n for *_, n in done) == [1, 2, 2]
