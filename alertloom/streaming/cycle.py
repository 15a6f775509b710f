"""Continuous operation: micro-batches through the batch plan, and keyed dedup that forgets after a time."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

#: The state store that values with a time to live need; set it where the session is built, or before the query starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_cycles(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, fail_fast: bool = False, failed: list | None = None) -> StreamingQuery:
    """Run ``step`` on every micro-batch: correlation state is per batch, as a cycle sees only what it fetched.

    A batch that fails is recorded in ``failed`` and passed over, unless ``fail_fast``. ``every``: a processing-time interval, or
    None for all that is available now. Offsets are in ``checkpoint``, so a restart goes on where the last batch ended; no row is dropped for a batch limit.
    """

    def one(batch: DataFrame, number: int) -> None:
        try:
            step(batch, number)
        except Exception as error:
            if fail_fast:
                raise
            if failed is not None:
                failed.append((number, str(error)[:500]))

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def with_pushes(step: Callable[[DataFrame, int], dict[str, DataFrame] | None], pushes: dict[str, Callable[[DataFrame], int | None]], sent: list, errors: list) -> Callable[[DataFrame, int], None]:
    """``step``, then each push of the result that it names: rows sent go to ``sent``, a failure to ``errors``, and neither stops the others or the cycles.

    Pushes come after the step, so what they send is written already.
    """

    def run(batch: DataFrame, number: int) -> None:
        results = step(batch, number) or {}
        for name, push in pushes.items():
            try:
                if name in results:
                    sent.append((number, name, int(push(results[name]) or 0)))
            except Exception as error:
                errors.append((number, name, str(error)[:500]))

    return run


class CycleLog(StreamingQueryListener):
    """Totals of the queries of a session, and one line of JSON a cycle to ``write`` (such as a file's write): add it with ``spark.streams.addListener``."""

    def __init__(self, write: Callable[[str], object] | None = None) -> None:
        self.write, self.cycles, self.rows, self.failed = write, 0, 0, 0

    def _log(self, event: str, **fields) -> None:
        if self.write is not None:
            self.write(json.dumps({"event": event, **fields}, sort_keys=True) + "\n")

    def onQueryStarted(self, event) -> None:
        self._log("started", query=str(event.id))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.cycles, self.rows = self.cycles + 1, self.rows + p.numInputRows
        self._log("cycle_completed", query=str(p.id), cycle=p.batchId, raw_events=p.numInputRows, at=p.timestamp, milliseconds=p.batchDuration)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.failed += event.exception is not None
        self._log("terminated", query=str(event.id), error=event.exception and event.exception[:500])


def dedup_with_ttl(stream: DataFrame, key: str, hours: int = 24) -> DataFrame:
    """The first row of each key; a key is forgotten ``hours`` of processing time after the row that passed, and may pass again then.

    The time of each micro-batch is the event time of the state: it advances only with new rows, so the query idles, and ends
    when all that is available has been read. A forgotten key's state goes with a later batch.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    at, life = "_arrived_at", hours * 3_600_000
    columns = [f.name for f in stream.schema.fields]

    def first(keys, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        for rows in batches:
            now = int(rows[at].iloc[0].timestamp() * 1000)
            if not state.exists or state.get[0] <= now:
                state.update((now + life,))
                yield rows[columns].head(1)
            state.setTimeoutTimestamp(max(state.get[0], state.getCurrentWatermarkMs() + 1))

    arriving = stream.withColumn(at, F.current_timestamp()).withWatermark(at, "0 seconds")
    return arriving.groupBy(key).applyInPandasWithState(first, stream.schema, "expires bigint", "append", GroupStateTimeout.EventTimeTimeout)


class _FirstOfKey(StatefulProcessor):
    """Lets a key's first row pass and remembers the key for a time, which begins anew with each row that passes."""

    def __init__(self, life_ms: int) -> None:
        self.life_ms = life_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.passed = handle.getValueState("passed", "at long", ttlDurationMs=self.life_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        if not self.passed.exists():
            self.passed.update((timerValues.getCurrentProcessingTimeInMs(),))
            yield next(iter(rows))

    def close(self) -> None:
        pass


def dedup_continuous(stream: DataFrame, key: str, seconds: float = 24 * 3600) -> DataFrame:
    """As ``dedup_with_ttl`` for a query that runs on: the state store itself forgets a key, ``seconds`` after the row that passed, also while no rows come.

    It needs the state store of ``STATE_STORE``. With an availableNow trigger such a query does not end by itself, as
    processing time always makes another batch: use ``dedup_with_ttl`` there.
    """
    if stream.sparkSession.conf.get(STATE_STORE[0], "") != STATE_STORE[1]:
        raise ValueError("set {} to {}".format(*STATE_STORE))
    return stream.groupBy(key).transformWithState(_FirstOfKey(int(seconds * 1000)), stream.schema, "Append", "ProcessingTime")


def dedup_by_event_time(stream: DataFrame, key: str, ts: str = "event_ts", hours: int = 24) -> DataFrame:
    """As above by event time, with Spark's own operator and a watermark."""
    return stream.withWatermark(ts, f"{hours} hours").dropDuplicatesWithinWatermark([key])


def hourly_counts(stream: DataFrame, ts: str = "event_ts", by: str = "action", late: str = "10 minutes") -> DataFrame:
    """Tumbling one-hour counts."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), by).agg(F.count(F.lit(1)).alias("n"))
