"""Streams with state per key in Spark's own state store: value and list state, timers, time-to-live.

Each processor keeps a few numbers or a bounded list per key. Rows of a key come in pieces and are
passed on in pieces where the answer allows it; where their order within a micro-batch matters, what is
put in order is one key's rows of one micro-batch, so bound these at the source (``maxFilesPerTrigger``
or ``maxBytesPerTrigger``). The state survives restarts with the checkpoint and is read back as a table
with ``state_table``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AllButFirst(StatefulProcessor):
    """Passes on every row of a key but its first by ``seq``; the state is that first number.

    Of the rows of the micro-batch in which a key appears, only the smallest so far is held back.
    """

    def __init__(self, seq: str, ttl_ms: int | None = None):
        self.seq, self.ttl_ms = seq, ttl_ms

    def init(self, handle) -> None:
        self.first = handle.getValueState("first", "seq long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.first.exists():
            yield from rows
            return
        held = None
        for frame in rows:
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            at = int(frame[self.seq].to_numpy().argmin())
            held = frame.iloc[[at]]
            yield frame.drop(index=frame.index[at])
        self.first.update((int(held[self.seq].iloc[0]),))

    def close(self) -> None:
        pass


class Visits(StatefulProcessor):
    """Adds to each row how many rows of its key came before, and the bonus that falls with it."""

    def __init__(self, seq: str, beta: float, ttl_ms: int | None = None):
        self.seq, self.beta, self.ttl_ms = seq, beta, ttl_ms

    def init(self, handle) -> None:
        self.visits = handle.getValueState("visits", "n long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = int(self.visits.get()[0]) if self.visits.exists() else 0
        frame = pd.concat(list(rows)).sort_values(self.seq, kind="stable")
        seen = before + np.arange(len(frame))
        self.visits.update((before + len(frame),))
        yield frame.assign(n_before=seen, bonus=self.beta / (np.sqrt(seen + 1.0) + 1e-8))

    def close(self) -> None:
        pass


class MovingAverage(StatefulProcessor):
    """Moving average per key, started by its first value; emits (key, n, ema) whenever a key has new rows."""

    def __init__(self, key: str, order: list[str], value: str, mu: float, ttl_ms: int | None = None):
        self.key, self.order, self.value, self.mu, self.ttl_ms = key, order, value, mu, ttl_ms

    def init(self, handle) -> None:
        self.average = handle.getValueState("average", "n long, ema double", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        values = pd.concat(list(rows)).sort_values(self.order, kind="stable")[self.value].to_numpy(np.float64)
        n, ema = (int(x) if i == 0 else float(x) for i, x in enumerate(self.average.get())) if self.average.exists() else (0, None)
        if ema is None:
            ema, values, n = float(values[0]), values[1:], 1
        weights = self.mu ** np.arange(len(values) - 1, -1, -1.0)
        ema = self.mu ** len(values) * ema + (1 - self.mu) * float(weights @ values)
        self.average.update((n + len(values), ema))
        yield pd.DataFrame({self.key: [key[0]], "n": [n + len(values)], "ema": [ema]})

    def close(self) -> None:
        pass


class Buffer(StatefulProcessor):
    """The last ``capacity`` rows of a shard, none more than ``max_age`` behind its newest, as list state.

    With ``idle_ms`` and an event-time column, a shard that sees no row for so long is emptied when the
    watermark passes its timer; rows behind the watermark don't arrive at all.
    """

    def __init__(self, columns: list[str], types: str, seq: str, capacity: int, max_age: int, idle_ms: int | None = None, ts: str | None = None):
        self.columns, self.types, self.seq, self.capacity, self.max_age, self.idle_ms, self.ts = columns, types, seq, capacity, max_age, idle_ms, ts

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.types)

    def kept(self, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(self.seq, kind="stable").tail(self.capacity)
        return frame[frame[self.seq] > frame[self.seq].iloc[-1] - self.max_age - 1]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = list(self.rows.get()) if self.rows.exists() else []
        frame, latest = pd.DataFrame(old, columns=self.columns) if old else None, None
        for part in rows:
            if self.idle_ms is not None:
                top = int(part[self.ts].max().timestamp() * 1000)
                latest = top if latest is None else max(latest, top)
            part = part[self.columns]
            frame = self.kept(part if frame is None else pd.concat([frame, part]))
        self.rows.put([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in frame.itertuples(index=False, name=None)])
        if latest is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(latest + self.idle_ms)
        yield pd.DataFrame({"shard": [key[0]], "n": [len(frame)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.rows.clear()
        yield pd.DataFrame({"shard": [key[0]], "n": [0]})

    def close(self) -> None:
        pass


def with_columns(schema: T.StructType, more: str) -> T.StructType:
    return T.StructType([*schema.fields, *T._parse_datatype_string(more).fields])


def repeated_tasks(stream: DataFrame, task: str, seq: str, ttl_ms: int | None = None) -> DataFrame:
    """Every row of a task but its very first; a task not seen for ``ttl_ms`` counts as new again."""
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return stream.groupBy(task).transformWithStateInPandas(AllButFirst(seq, ttl_ms), stream.schema, "Append", mode)


def novelty(stream: DataFrame, state_hash: str, seq: str, beta: float = 0.1, ttl_ms: int | None = None) -> DataFrame:
    """Rows with ``n_before`` and ``bonus``, counting visits across micro-batches."""
    mode = "None" if ttl_ms is None else "ProcessingTime"
    schema = with_columns(stream.schema, "n_before long, bonus double")
    return stream.groupBy(state_hash).transformWithStateInPandas(Visits(seq, beta, ttl_ms), schema, "Append", mode)


def running_ema(stream: DataFrame, key: str, order: list[str], value: str, mu: float, ttl_ms: int | None = None) -> DataFrame:
    """(key, n, ema) of the keys with new rows, micro-batch by micro-batch; the state holds the latest of all."""
    mode = "None" if ttl_ms is None else "ProcessingTime"
    schema = with_columns(T.StructType([stream.schema[key]]), "n long, ema double")
    return stream.groupBy(key).transformWithStateInPandas(MovingAverage(key, order, value, mu, ttl_ms), schema, "Update", mode)


def bounded_buffer(stream: DataFrame, seq: str, capacity: int, max_age: int, shards: int = 8, idle_ms: int | None = None, ts: str | None = None) -> DataFrame:
    """Keep the newest rows, ``shards`` lists side by side; emits the size of each list that changed.

    Every shard could hold all of the newest rows, so each keeps ``capacity``; ``newest`` reads them.
    """
    fields = [f for f in stream.schema if f.name != ts]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    buffer = Buffer([f.name for f in fields], types, seq, capacity, max_age, idle_ms, ts)
    keyed = stream.withColumn("shard", F.pmod(F.xxhash64(seq), F.lit(shards)).cast("int"))
    mode = "None" if idle_ms is None else "EventTime"
    return keyed.groupBy("shard").transformWithStateInPandas(buffer, "shard int, n long", "Update", mode)


def run_available(df: DataFrame, out: str, checkpoint: str) -> None:
    """Process everything available and stop; what is emitted goes to ``out``, one folder per micro-batch."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    # State of this kind lives in RocksDB alone; a query keeps the setting it is started under.
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKSDB)
    try:
        query = df.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(PROVIDER, before)
    query.awaitTermination()


def state_table(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """A state variable of a stopped stream as a table: the key's columns and the value's."""
    found = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    value = "list_element" if "list_element" in found.columns else "value"
    return found.select("key.*", f"{value}.*")


def newest(rows: DataFrame, seq: str, capacity: int, max_age: int) -> DataFrame:
    """What the shards' lists hold together: the last ``capacity`` rows not more than ``max_age`` old."""
    last: Column = rows.agg(F.max(seq)).scalar()
    return rows.where(F.col(seq) >= last - max_age).orderBy(F.desc(seq)).limit(capacity)
