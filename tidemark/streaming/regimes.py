"""Regime updates on a stream: one filtered state vector per series, alerts, capped history, counters."""

from __future__ import annotations

import time
from collections import Counter, deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from tidemark.operators.hmm import HmmParams, log_density, prepare_regime_features
from tidemark.operators.regime import regime_labels

OUTPUT = "{key}, ts timestamp, regime string, confidence double, transition_probability double, to_regime string, seen long, rejected long"
STATE = "alpha array<double>, last_us long, seen long, rejected long, regime string"
HISTORY = "us long, regime string, confidence double"
#: Rows handed on at a time.
OUT_ROWS = 10_000


class RegimeUpdate(StatefulProcessor):
    """Per key: forward vector, time of the last update, counters and the last updates.

    A row at or before the last update is rejected. Nothing is emitted until ``min_rows`` rows were seen.
    """

    def __init__(self, params: HmmParams, keys: Sequence[str], min_rows: int, min_confidence: float, alert_threshold: float, history: int):
        self.p, self.keys, self.min_rows = params, list(keys), min_rows
        self.min_confidence, self.alert, self.history = min_confidence, alert_threshold, history
        self.labels = params.labels or regime_labels(params.k)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE)
        self.past = handle.getListState("history", HISTORY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        saved = self.state.get() if self.state.exists() else None
        alpha, last, seen, rejected, regime = (np.array(saved[0]) if saved else None, *(saved[1:] if saved else (None, 0, 0, None)))
        past = deque(self.past.get() if self.past.exists() else (), maxlen=self.history)
        names = [*self.keys, "ts", "regime", "confidence", "transition_probability", "to_regime", "seen", "rejected"]
        out: list[tuple] = []

        def frame() -> pd.DataFrame:
            d = pd.DataFrame([(*key, *row) for row in out], columns=names)
            return d.assign(ts=np.array([row[0] for row in out], "i8").astype("M8[us]").astype("M8[ns]"))

        for us, b in self._by_time(rows):
            if last is not None and us <= last:
                rejected += 1
                continue
            prior = self.p.start if alpha is None else alpha @ self.p.trans
            alpha = prior * np.exp(b - b.max())
            alpha = alpha / alpha.sum()
            last, seen = us, seen + 1
            if seen < self.min_rows:
                continue
            conf = float(alpha.max())
            now = self.labels[int(alpha.argmax())] if conf >= self.min_confidence else "Uncertain"
            prob, to = self._alert(regime)
            regime = now
            past.append((us, now, conf))
            out.append((us, now, conf, prob, to, seen, rejected))
            if len(out) == OUT_ROWS:
                yield frame()
                out.clear()
        if alpha is not None:
            self.state.update((alpha.tolist(), last, seen, rejected, regime))
            self.past.put(list(past))
        yield frame()

    def _by_time(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray]]:
        """Times in microseconds and log densities of a micro-batch's rows, by time; equal times in the order of arrival.

        Of the rows nothing else is held: 8 * (K + 2) bytes each, and 8 * K more while the pieces are put together.
        """
        us, dens = [], []
        for d in rows:
            us.append(d["ts"].astype("datetime64[us]").astype("int64").to_numpy())
            dens.append(log_density(np.stack(d["x"]), self.p))
        us = np.concatenate(us)
        dens = np.concatenate(dens)
        order = np.argsort(us.view("M8[us]"), kind="stable")  # without a time last
        for at in range(0, len(order), OUT_ROWS):
            some = order[at : at + OUT_ROWS]
            yield from zip(us[some].tolist(), dens[some])

    def _alert(self, regime: str | None):
        if regime not in self.labels:
            return None, None
        i = self.labels.index(regime)
        hits = [(float(q), self.labels[j]) for j, q in enumerate(self.p.trans[i]) if j != i and q > self.alert]
        return hits[-1] if hits else (None, None)

    def close(self) -> None:
        pass


def regime_stream(
    stream: DataFrame, params: HmmParams, key: Sequence[str] = ("event_type",), min_rows: int = 63, min_confidence: float = 0.6, alert_threshold: float = 0.7,
    history: int = 100, order: str = "ts",
) -> DataFrame:
    """Regime, confidence and transition alert per incoming row of each series.

    State per series is K numbers, two counters and at most ``history`` past updates. Of a micro-batch a task holds times
    and densities of one series, as arrays, and hands on its updates as they are made. The session needs the
    RocksDB state store (``use_rocksdb``).
    """
    d = stream if "x" in stream.columns else prepare_regime_features(stream, list(params.prep.limits), params.prep)[0]
    d = d.withColumn("ts", d[order].cast("timestamp")).select(*key, "ts", "x")
    kinds = {f.name: f.dataType.simpleString() for f in d.schema}
    schema = OUTPUT.format(key=", ".join(f"{k} {kinds[k]}" for k in key))
    return d.groupBy(*key).transformWithStateInPandas(
        statefulProcessor=RegimeUpdate(params, key, min_rows, min_confidence, alert_threshold, history), outputStructType=schema, outputMode="Append", timeMode="None"
    )


def update_history(spark: SparkSession, state: str, key: Sequence[str] = ("event_type",), last: int | None = None) -> DataFrame:
    """The past updates that a regime stream keeps, read from its state: ``key, ts, regime, confidence``.

    ``state`` is the query's checkpoint folder; the stream need not run. Reads all state partitions in parallel; ``last``
    keeps the newest of each series, of which the state holds at most ``history``.
    """
    h = spark.read.format("statestore").option("path", state).option("stateVarName", "history").load()
    e = F.col("list_element")
    d = h.select(*[F.col(f"key.{k}").alias(k) for k in key], F.timestamp_micros(e["us"]).alias("ts"), e["regime"].alias("regime"), e["confidence"].alias("confidence"))
    if last is None:
        return d
    newest = Window.partitionBy(*key).orderBy(F.col("ts").desc())  # at most ``history`` rows
    return d.withColumn("_i", F.row_number().over(newest)).filter(F.col("_i") <= last).drop("_i")


def counted(df: DataFrame, failed: Column, name: str = "updates") -> DataFrame:
    """Count rows and failures as they pass, without a pass of their own: a stream reports them with each batch
    (``UpdateCounters.observed``), a batch job through the query's listener or an ``Observation``."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(failed).alias("failures"))


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class UpdateCounters(StreamingQueryListener):
    """Batches, rows, failures and mean batch time over the last 100 batches of all queries of a session."""

    def __init__(self):
        self.batches = self.rows = self.failures = self.finished = 0
        self.times = deque(maxlen=100)
        self.observed = Counter()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.batches += 1
        self.rows += event.progress.numInputRows
        self.times.append(event.progress.batchDuration)
        for name, row in event.progress.observedMetrics.items():
            self.observed.update({f"{name}_{c}": v for c, v in row.asDict().items() if v is not None})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.finished += 1
        self.failures += event.exception is not None

    def wait(self, finished: int = 1, seconds: float = 60.0) -> None:
        """Until that many queries are seen to end: events arrive after the query's own thread goes on, in their order."""
        end = time.monotonic() + seconds
        while self.finished < finished:
            if time.monotonic() > end:
                raise TimeoutError(f"{self.finished} of {finished} queries seen to end within {seconds} s")
            time.sleep(0.05)

    def summary(self) -> dict[str, float]:
        total = self.batches + self.failures
        return {
            "batches": self.batches, "rows": self.rows, "failures": self.failures, "success_rate": self.batches / total if total else 0.0,
            "mean_batch_ms": sum(self.times) / len(self.times) if self.times else 0.0,
        }
