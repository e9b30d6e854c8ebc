"""Streams give what batches give; late, duplicate and broken rows are kept out."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.catalog import stream as cs
from tidemark.operators import hmm
from tidemark.streaming import bars as sb
from tidemark.streaming import regimes as sr


def test_bars_stream_equals_batch(spark, sf):
    live = {(r["event_type"], r["start"]): r["close"] for r in cs.stream_bars_live(spark, sf).collect()}
    batch = {(r["event_type"], r["start"]): r["close"] for r in cs.stream_bars(spark, sf).collect()}
    assert live and live.items() <= batch.items() and len(batch) - len(live) <= 20


def test_duplicates_and_quarantine(spark, sf):
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    assert cs.dedupe_stream(spark, sf).agg(F.sum("n")).first()[0] == n
    q = {r["reason"]: r["n"] for r in cs.quarantine_stream(spark, sf).collect()}
    assert sum(q.values()) == n and q["missing value"] > 0
    d = sb.dedupe(spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:00")], "event_type string, ts string"))
    assert d.count() == 1


@pytest.fixture(scope="module")
def updates(spark, sf):
    counters = sr.UpdateCounters()
    spark.streams.addListener(counters)
    sr.use_rocksdb(spark)
    s = cs.source(spark, sf)
    late = s.unionByName(s.filter("event_id % 50 = 0").withColumn("ts", F.expr("ts - interval 40 days")))
    out = cs.drain(spark, sr.regime_stream(late, cs.stream_params(), min_rows=10, history=5)).cache()
    out.count()
    spark.streams.removeListener(counters)
    return out, counters


def test_regime_updates(spark, sf, updates):
    out, _ = updates
    e = spark.read.parquet(f"{sf}/events.parquet").filter("event_type = 'click'").withColumn("ts", F.col("ts").cast("timestamp"))
    extra = e.filter("event_id % 50 = 0").withColumn("ts", F.expr("ts - interval 40 days"))
    pdf = e.unionByName(extra).orderBy("ts").toPandas().drop_duplicates("ts")
    p = cs.stream_params()
    a, want = None, []
    for b in hmm.log_density((pdf["value"].clip(0, 100).to_numpy()[:, None] - 20) / 10, p):
        a = (p.start if a is None else a @ p.trans) * np.exp(b)
        a = a / a.sum()
        want.append(a.max())
    got = [r["confidence"] for r in out.filter("event_type = 'click'").orderBy("ts").collect()]
    np.testing.assert_allclose(got, want[9:], atol=1e-9)
    low = out.filter("confidence < 0.6").select("regime").distinct().collect()
    assert [r["regime"] for r in low] in ([], ["Uncertain"])
    alerts = out.filter("transition_probability is not null").select("to_regime", "transition_probability").distinct().collect()
    assert [(r["to_regime"], r["transition_probability"]) for r in alerts] == [("High Vol", 0.8)]


def test_late_rows_are_rejected(spark):
    sr.use_rocksdb(spark)
    path = tempfile.mkdtemp(prefix="tidemark-")
    rows = lambda ts: spark.createDataFrame([("a", t, 10.0) for t in ts], "event_type string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows([f"2024-01-01 0{i}:00:00" for i in range(4)]).coalesce(1).write.parquet(path + "/1")
    s = spark.readStream.schema("event_type string, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(path + "/*")
    d = sr.regime_stream(s, cs.stream_params(), min_rows=1)
    out, ckpt = tempfile.mkdtemp(prefix="tidemark-"), tempfile.mkdtemp(prefix="tidemark-")

    def run():
        q = d.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    rows(["2024-01-01 02:30:00", "2024-01-01 03:00:00", "2024-01-01 05:00:00"]).coalesce(1).write.parquet(path + "/2")
    run()
    r = spark.read.schema(d.schema).parquet(out).orderBy("ts").collect()
    assert len(r) == 5 and r[-1]["seen"] == 5 and r[-1]["rejected"] == 2


def test_counters(updates):
    c = updates[1].summary()
    assert c["failures"] == 0 and (c["batches"] == 0 or c["success_rate"] == 1.0)
