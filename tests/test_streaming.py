import time

from pyspark.sql import functions as F

from textloom.streaming.monitor import first_seen, scanned, token_windows


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "mail a@example.com", "2024-01-01 00:10:00"), (2, "Mail  A@example.com", "2024-01-01 00:20:00"), (3, "other words", "2024-01-01 01:10:00")], "id int, text string, at string")
    rows.withColumn("at", F.to_timestamp("at")).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id int, text string, at timestamp").parquet(str(tmp_path / "in"))
    stamp = str(int(time.time()))
    drain(scanned(source), f"s{stamp}")
    assert spark.table(f"s{stamp}").where(F.size("pii") > 0).count() == 2
    drain(first_seen(source, "at"), f"f{stamp}")
    assert spark.table(f"f{stamp}").count() == 2
    drain(token_windows(source.withColumn("lang", F.lit("en")), "at", "lang"), f"t{stamp}", "complete")
    assert {r.n for r in spark.table(f"t{stamp}").collect()} == {1, 2}
