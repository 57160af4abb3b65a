"""Breaker states of a stream against those of its log, over restarts."""

import random

from marlstone.streaming.breaker import breaker_stream
from marlstone.streaming.feeds import breaker_states


def test_stream_gives_the_states_of_the_log(spark, tmp_path):
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        pick = random.Random(2)
        rows = [(pick.choice("aab"), i, 1000 + i * 10, pick.random() < 0.4) for i in range(120)]
        rows += [("c", 200 + i, 2300 + i, False) for i in range(3)] + [("z", 300, 10_000_000, True)]
        schema = "service string, seq long, ms long, ok boolean"
        for lo in (0, 60, 120):  # three files, three runs of the stream
            spark.createDataFrame(rows[lo : lo + 60] if lo < 120 else rows[120:], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
            breaker_stream(stream, 2, 40, "1 minute").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        got = spark.read.parquet(str(tmp_path / "out"))
        want = {(r.service, r.seq): r.state for r in breaker_states(spark.createDataFrame(rows, schema), 2, 40).collect()}
        assert {(r.service, r.seq): r.state for r in got.filter("seq IS NOT NULL").collect()} == want and set(want.values()) == {"closed", "open", "half-open"}
        assert ("c", 2301 + 40) in {(r.service, r.ms) for r in got.filter("seq IS NULL").collect()}
    finally:
        spark.conf.unset(store)
