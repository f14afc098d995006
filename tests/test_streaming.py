from pyspark.sql import functions as F

from tracklark.operators import folds, sequence
from tracklark.sources.tables import events, micros, table
from tracklark.streaming.stateful import stream_hysteresis, stream_sessions

SMALL = "/root/testdata/sf0.001"
GAP = 6 * 3_600_000_000


def drained(query, spark, name):
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_sessions_agree_with_the_batch_form(spark, tmp_path):
    rows = table(spark, SMALL, "events").select("user_id", F.timestamp_micros(micros("ts")).alias("ts"), micros("ts").alias("t"), F.floor(F.col("value") * 100 + 0.5).alias("cents"))
    (tmp_path / "in").mkdir()
    end = spark.createDataFrame([(-1, 0)], "user_id long, cents long").select("user_id", F.lit("2030-01-01").cast("timestamp").alias("ts"), F.lit(1893456000000000).alias("t"), "cents")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = stream_sessions(stream, GAP, "1 hour")
    q = out.writeStream.format("memory").queryName("sessions_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q.processAllAvailable()
    end.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = drained(q, spark, "sessions_out").filter("user_id >= 0")
    batch = sequence.sessionize(events(spark, SMALL), ["user_id"], "t", "event_id", GAP).groupBy("user_id", "session").agg(F.min("t"), F.max("t"), F.count("*"), F.sum("cents")).drop("session")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_hysteresis_agrees_with_the_batch_form(spark, tmp_path):
    instant = F.when(F.col("cents") < 500, "stationary").when(F.col("cents") < 1500, "creeping").otherwise("moving")
    rows = events(spark, SMALL).select("user_id", "t", "event_id", instant.alias("instant"))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    need = {"moving": 2, "stationary": 3}
    q = stream_hysteresis(stream, need).writeStream.format("memory").queryName("states_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    got = drained(q, spark, "states_out")
    batch = folds.hysteresis_states(rows, ["user_id"], ["t", "event_id"], "instant", need).select("user_id", "event_id", "state")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
