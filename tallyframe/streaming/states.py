"""Change events of a stream by keyed state: rows wait for the watermark, so events come out in event time, whatever order rows arrive in."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: The state store that keyed state with timers needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Changes(StatefulProcessor):
    """Per key: the last status, and the rows that the watermark hasn't reached.

    A timer at each waiting row's time takes it in; one at ``silent`` milliseconds after the last status ends the key.
    """

    def __init__(self, silent: int | None, keys: int):
        self.silent, self.keys = silent, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("at", LongType()), StructField("status", StringType())]))
        self.waiting = handle.getMapState("waiting", StructType([StructField("at", LongType())]), StructType([StructField("status", StringType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, late = self.last.get(), []
        for part in rows:
            # of several statuses at one time the greatest counts, as in the batch form; no status is least
            best = part.groupby("at")["status"].agg(lambda s: max((x for x in s if x is not None), default=None))
            for at, status in best.items():
                if last is not None and at <= last[0]:
                    late.append((at, status, None, "late"))
                    continue
                at = int(at)
                known = self.waiting.getValue((at,)) if self.waiting.containsKey((at,)) else None
                if known is None:
                    self.handle.registerTimer(at)
                elif status is None or (known[0] is not None and known[0] >= status):
                    continue
                self.waiting.updateValue((at,), (status,))
        if late:
            yield self.shown(key, late)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto, out = timerValues.getCurrentWatermarkInMs(), []
        ready = sorted(at for (at,) in self.waiting.keys() if at <= upto)
        last = self.last.get()
        for at in ready:
            status = self.waiting.getValue((at,))[0]
            if last is not None and self.silent is not None and at > last[0] + self.silent:
                out.append((last[0] + self.silent, None, last[1], "silent"))
                last = None
            kind = "first" if last is None else "same" if last[1] == status else "changed"
            out.append((at, status, None if last is None else last[1], kind))
            last = (at, status)
            self.waiting.removeKey((at,))
        if last is not None and self.silent is not None:
            end = last[0] + self.silent
            if end < upto and not any(at <= end for (at,) in self.waiting.keys()):
                out.append((end, None, last[1], "silent"))
                last = None
            elif ready:
                self.handle.registerTimer(end + 1)
        if last is None:
            self.last.clear()
        elif ready:
            self.last.update(last)
        if out:
            yield self.shown(key, out)

    def shown(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        found = pd.DataFrame(rows, columns=["at", "status", "previous", "kind"])
        return pd.concat([pd.DataFrame([key] * len(rows), columns=[f"k{i}" for i in range(self.keys)]), found], axis=1)

    def close(self) -> None:
        pass


def change_events(stream: DataFrame, keys: Sequence[str], at: str, status: str, delay: str, silent_ms: int | None = None) -> DataFrame:
    """Events of a stream of observations: ``keys``, ``at``, ``status``, ``previous`` and ``kind``.

    kind: ``first``, ``same`` or ``changed`` against the key's observation before in event time; ``silent`` where a key has had
    none for more than ``silent_ms`` (its state ends, and the next is ``first`` again); ``late`` for rows that come after the watermark, ``delay``
    behind the newest row seen, and a later observation of their key was taken in: they change nothing. Rows within ``delay`` may come in any
    order and in any batches. The state is a row per key and the rows that still wait; a batch reads the state of its own keys only.
    """
    timed = stream.withWatermark(at, delay)
    # the column with the watermark stays out of the grouped rows, else late rows would be dropped unseen
    rows = timed.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.unix_millis(F.col(at)).alias("at"), F.col(status).cast("string").alias("status"))
    names = [f"k{i}" for i in range(len(keys))]
    schema = StructType([*(rows.schema[n] for n in names), StructField("at", LongType()), *(StructField(n, StringType()) for n in ("status", "previous", "kind"))])
    found = rows.groupBy(*names).transformWithStateInPandas(_Changes(silent_ms, len(keys)), schema, "Append", "EventTime")
    return found.select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), F.timestamp_millis("at").alias(at), F.col("status").alias(status), "previous", "kind")


def write_change_events(stream: DataFrame, root: str, keys: Sequence[str], at: str, status: str, delay: str, checkpoint: str, silent_ms: int | None = None) -> StreamingQuery:
    """Append ``change_events`` to a table under ``root``; started again, the query goes on from its checkpoint."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    events = change_events(stream, keys, at, status, delay, silent_ms)
    return events.writeStream.format("parquet").option("path", root).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
