"""Rules that need a key's events in order, on streams: keyed state with event-time timers.

Events of a key wait in list state until the watermark has passed them, so that their order in the input, equal times and late ones
within the allowed delay don't matter; a timer at the earliest of them wakes the key (a timer that finds nothing due does nothing). What is later than the watermark when it arrives is dropped by
the engine, and so are events from before 1970. After a restart from its checkpoint a stream goes on from the same state. Events without a time are ignored.

A stream with these operators needs a state store of column families
(``spark.sql.streaming.stateStore.providerClass``); ``with_state_store`` sets the engine's own if the session names none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def with_state_store(spark: SparkSession) -> SparkSession:
    """A session of its own whose streams keep keyed state in column families."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.checkpoint.dir"):
        if (value := spark.conf.get(name, None)) is not None and own.conf.isModifiable(name):
            own.conf.set(name, value)
    if "RocksDB" not in own.conf.get(PROVIDER):
        own.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


class _Ordered(StatefulProcessor):
    """Gives a key's rows to ``step`` by time as the watermark passes them, and lets it say when it wants to be woken again."""

    row, kept = "at_ms long", "at_ms long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.state = handle.getListState("state", self.kept)

    def step(self, key: tuple, state: list[tuple], rows: list[tuple], upto: int) -> tuple[list[tuple], list[tuple], int | None]:
        """From a key's state and its rows in order up to a time: the new state, what to report, and when to wake the key if nothing comes."""
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names, earliest = [x.split()[0] for x in self.row.split(", ")], None
        for batch in rows:
            fresh = [tuple(int(v) for v in x) for x in batch[names].itertuples(index=False, name=None)]
            if fresh:
                self.waiting.appendList(fresh)
                earliest = min(x[0] for x in fresh) if earliest is None else min(earliest, min(x[0] for x in fresh))
        if earliest is not None:
            self.handle.registerTimer(earliest)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(x) for x in self.waiting.get())
        due, later = [x for x in held if x[0] <= upto], [x for x in held if x[0] > upto]
        state, report, again = self.step(key, [tuple(x) for x in self.state.get()], due, upto)
        for place, left in ((self.waiting, later), (self.state, state)):
            if left:
                place.put(left)
            else:
                place.clear()
        wanted = [t for t in (again, later[0][0] if later else None) if t is not None]
        if wanted:
            self.handle.registerTimer(min(wanted))
        if report:
            yield pd.DataFrame([(*key, *r) for r in report], columns=self.columns)

    def close(self) -> None:
        pass


class _Bursts(_Ordered):
    kept = "first_ms long, last_ms long, n long, reported long"

    def __init__(self, debounce_ms: int, quiet_ms: int):
        self.debounce_ms, self.quiet_ms = debounce_ms, quiet_ms
        self.columns = ["key_", "null_", "first_ms", "last_ms", "n"]

    def step(self, key, state, rows, upto):
        burst, report = (list(state[0]) if state else None), []
        for (at,) in rows:
            if burst and at <= burst[1] + self.debounce_ms:
                burst[1:3] = at, burst[2] + 1
            elif not burst or at >= burst[1] + self.debounce_ms + self.quiet_ms:
                if burst and not burst[3]:
                    report.append(tuple(burst[:3]))
                burst = [at, at, 1, 0]
        if burst is None:
            return [], report, None
        end = burst[1] + self.debounce_ms
        if upto >= end and not burst[3]:
            report.append(tuple(burst[:3]))
            burst[3] = 1
        if upto >= end + self.quiet_ms:  # the quiet time is over: nothing is remembered
            return [], report, None
        return [tuple(burst)], report, end if upto < end else end + self.quiet_ms


class _Admitted(_Ordered):
    row, kept = "at_ms long, id long", "at_ms long"

    def __init__(self, most: int, within_ms: int):
        self.most, self.within_ms = most, within_ms
        self.columns = ["key_", "null_", "at_ms", "id", "admitted"]

    def step(self, key, state, rows, upto):
        log, report = [x[0] for x in state], []
        for at, id_ in rows:
            log = [t for t in log if at - t < self.within_ms]
            report.append((at, id_, len(log) < self.most))
            if report[-1][2]:
                log.append(at)
        log = [t for t in log if upto - t < self.within_ms]
        return [(t,) for t in log], report, log[0] + self.within_ms if log else None


def _run(events: DataFrame, columns: list[str], late: str, processor: _Ordered, schema: str) -> DataFrame:
    """Keys are grouped by text and a mark for null, since a null makes pandas read a batch's other keys as other numbers."""
    at = F.timestamp_millis(F.col("at_ms").cast("long"))
    key = F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key_"), F.col("key").isNull().cast("int").alias("null_")
    rows = events.filter("at_ms IS NOT NULL").select(*key, *columns, at.alias("event_time_")).withWatermark("event_time_", late)
    found = rows.groupBy("key_", "null_").transformWithStateInPandas(processor, f"key_ string, null_ int, {schema}", "Append", "EventTime")
    return found.withColumn("key", F.when(F.col("null_") == 0, F.col("key_")).cast(events.schema["key"].dataType)).select("key", *(x.split()[0] for x in schema.split(", ")))


def debounce_quiet(events: DataFrame, debounce_ms: int = 1500, quiet_ms: int = 1500, late: str = "10 minutes") -> DataFrame:
    """T1, T2 on a stream of events (key, at_ms): bursts as changes.debounce_quiet finds them in a table.

    A burst is reported when the watermark has passed its end; a key's state goes when its quiet period is over. Returns key, first_ms, last_ms, n.
    """
    return _run(events, ["at_ms"], late, _Bursts(debounce_ms, quiet_ms), "first_ms long, last_ms long, n long")


def admitted(attempts: DataFrame, most: int = 5, within_ms: int = 60_000, late: str = "10 minutes") -> DataFrame:
    """W7, T5 on a stream of attempts (key, at_ms, id): as changes.admitted decides in a table. A key's log holds at most so many times, and expires."""
    return _run(attempts, ["at_ms", "id"], late, _Admitted(most, within_ms), "at_ms long, id long, admitted boolean")


def replay(events: Callable[[SparkSession], DataFrame], rule: Callable[[DataFrame], DataFrame], spark: SparkSession, folder: str, last_ms: int) -> DataFrame:
    """Run a rule over all of a streamed table until its input is used up, and read what it reports.

    events: builds the stream (key, at_ms and what the rule needs) in a session. A marker without key at ``last_ms`` moves the watermark past all events at the end; no rule
    reports it, as the watermark does not pass it. folder: in the shared folder; keeps the checkpoint and the report.
    """
    own = with_state_store(spark)
    rows = events(own)
    marker = own.range(1).select(*(F.lit({"at_ms": last_ms, "key": None}.get(c, 0)).cast(t).alias(c) for c, t in rows.dtypes))
    marker.coalesce(1).write.mode("overwrite").parquet(f"{folder}/marker")
    ends = own.readStream.schema(rows.schema).parquet(f"{folder}/marker")
    found = rule(rows.filter("key IS NOT NULL").unionByName(ends))
    query = found.writeStream.format("parquet").option("path", f"{folder}/report").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/report")
