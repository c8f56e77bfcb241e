"""State that lives on between micro-batches, and calls that hang."""

import os
import sys
import time

from pyspark import cloudpickle
from pyspark.sql import functions as F

from guardspark.config import EngineConfig
from guardspark.operators.judge import SharedBreaker, ask, ask_all
from guardspark.streaming import jobs

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks do not import the tests
GOOD = '{"is_malicious": false, "verdict": "allow", "confidence": 0.5}'
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Noted:
    """Writes down each text that it is asked; fails while ``down`` exists."""

    def __init__(self, folder):
        self.folder = folder

    def ask(self, text):
        open(f"{self.folder}/asked-{text}-{time.monotonic_ns()}", "w").close()
        if os.path.exists(f"{self.folder}/down"):
            raise ConnectionError("down")
        return GOOD

    def asked(self):
        found = sorted(f.split("-")[1] for f in os.listdir(self.folder) if f.startswith("asked-"))
        for f in os.listdir(self.folder):
            if f.startswith("asked-"):
                os.remove(f"{self.folder}/{f}")
        return found


def test_breaker_lives_on_between_batches(spark, tmp_path):
    now, client = [1000.0], Noted(str(tmp_path))
    shared = SharedBreaker(failures=3, wait=60, clock=lambda: now[0])
    (tmp_path / "down").touch()

    def batch(n):
        rows = spark.range(n).coalesce(1).select(F.col("id").cast("string").alias("request_id"), F.col("id").cast("string").alias("raw_text"))
        held = []
        errors = [r.error for r in ask_all(rows, client, EngineConfig(), shared, held, "request_id").orderBy("request_id").collect()]
        shared.settle()
        for df in held:
            df.unpersist()
        return errors

    assert batch(2) == ["ConnectionError: down"] * 2 and shared.state() == "closed"
    assert batch(3) == ["ConnectionError: down", "skipped", "skipped"]  # the third failure in a row, over two batches
    assert shared.state() == "open" and client.asked() == ["0", "0", "1"]
    now[0] += 30
    assert batch(4) == ["skipped"] * 4 and client.asked() == []
    now[0] += 40
    assert shared.state() == "half_open"
    assert batch(4) == ["ConnectionError: down"] + ["skipped"] * 3 and client.asked() == ["0"]  # one call, and no other
    now[0] += 61
    os.remove(tmp_path / "down")
    assert batch(4) == [None] * 4 and client.asked() == ["0", "1", "2", "3"] and shared.state() == "closed"
    assert batch(0) == []


class Hangs:
    def ask(self, text):
        time.sleep(60 if text == "hang" else 0)
        return GOOD


def test_a_call_that_hangs_is_broken_off(spark):
    texts = ["x", "hang", "x", "hang", "x", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "request_id long, raw_text string").coalesce(1)
    began = time.time()
    rows = ask(df, Hangs(), EngineConfig(judge_timeout=0.5, judge_calls=6)).orderBy("request_id").collect()
    assert time.time() - began < 15
    assert [r.error for r in rows] == [None if t == "x" else "timeout" for t in texts]
    assert all(r.ms < 5000 for r in rows) and [r.ok for r in rows] == [t == "x" for t in texts]
    # Three of them in a row open the breaker.
    df = spark.createDataFrame([(i, "hang") for i in range(20)], "request_id long, raw_text string").coalesce(1)
    began = time.time()
    errors = [r.error for r in ask(df, Hangs(), EngineConfig(judge_timeout=0.5, judge_calls=2)).orderBy("request_id").collect()]
    assert time.time() - began < 15 and errors == ["timeout"] * 4 + ["skipped"] * 16


def test_limiter_state_goes_after_a_window(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    cfg, schema = EngineConfig(requests_per_minute=2, window_seconds=60), "tenant_key string, ts double, event_id long"
    names = iter(range(100))

    def more(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.parquet(str(tmp_path / f"in/{next(names)}"))
        source = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        q = jobs.limit_stream(source, cfg).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sum(op.numRowsDroppedByWatermark for p in q.recentProgress for op in p.stateOperators)

    def state():
        rows = spark.read.format("statestore").option("stateVarName", "kept").load(str(tmp_path / "cp")).collect()
        return {r.key[0] for r in rows}

    decided = lambda: {r.event_id: r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    (tmp_path / "in").mkdir()
    more(("a", 100.0, 1), ("a", 101.0, 2), ("a", 102.0, 3), ("b", 110.0, 4))
    assert decided() == {1: True, 2: True, 3: False, 4: True} and state() == {"a", "b"}
    more(("b", 130.0, 5), ("a", 125.0, 6))  # out of order, within the window
    assert decided()[5] and not decided()[6] and state() == {"a", "b"}
    assert more(("c", 400.0, 7)) == 0  # the watermark follows to 340: a and b are long over
    assert state() == {"c"}
    assert more(("a", 200.0, 8), ("a", 401.0, 9)) == 1  # too late for a decision: dropped and counted
    assert set(decided()) == {1, 2, 3, 4, 5, 6, 7, 9} and decided()[9]
