"""Bursts of changes and rate limits, for streams and for tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounce(events: DataFrame, quiet: str = "1500 milliseconds", late: str = "10 minutes") -> DataFrame:
    """One row for each burst: events of a key that follow each other within the quiet time, itself included. events: key, at (timestamp).

    On a stream a burst is reported when the watermark has passed its end.
    """
    if events.isStreaming:
        events = events.withWatermark("at", late)
    bursts = events.groupBy("key", F.session_window("at", quiet).alias("s")).agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    return bursts.select("key", "first", "last", "n")


def debounce_quiet(events: DataFrame, debounce_ms: int = 1500, quiet_ms: int = 1500) -> DataFrame:
    """Bursts of a table of events (key, at_ms), each followed by a quiet period in which events are discarded.

    A burst ends ``debounce_ms`` after its last event, itself included; what comes within ``quiet_ms`` of that neither counts nor begins
    a burst. Events without a time are ignored. Keys are dealt out and sorted; a key's state is its open burst. Returns key, first_ms, last_ms, n.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, first, last, n, key = False, 0, 0, 0, None
        for batch in batches:
            done = []
            for k, at, same in zip(batch["key"], batch["at_ms"], batch["key"].eq(batch["key"].shift()), strict=True):
                if open_ and (same or k == key or (pd.isna(k) and pd.isna(key))):
                    if at <= last + debounce_ms:
                        last, n = at, n + 1
                        continue
                    if at < last + debounce_ms + quiet_ms:
                        continue
                if open_:
                    done.append((key, first, last, n))
                open_, key, first, last, n = True, k, at, at, 1
            yield pd.DataFrame(done, columns=["key", "first_ms", "last_ms", "n"])
        if open_:
            yield pd.DataFrame([(key, first, last, n)], columns=["key", "first_ms", "last_ms", "n"])

    rows = events.filter("at_ms IS NOT NULL").select("key", F.col("at_ms").cast("long").alias("at_ms")).repartition("key").sortWithinPartitions("key", "at_ms")
    return rows.mapInPandas(run, f"key {events.schema['key'].dataType.simpleString()}, first_ms long, last_ms long, n long")


def admitted(attempts: DataFrame, most: int = 5, within_ms: int = 60_000) -> DataFrame:
    """A sliding log for each key: at most so many admitted attempts in any such time; refused ones are not logged.

    attempts: key, at_ms, id. Keys are dealt out and sorted; a key's state is the few admitted times, never its rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, log = None, []
        for batch in batches:
            ok = []
            for k, at in zip(batch["key"], batch["at_ms"], strict=True):
                if k != key:
                    key, log = k, []
                log = [t for t in log if at - t < within_ms]
                ok.append(len(log) < most)
                if ok[-1]:
                    log.append(at)
            yield batch.assign(admitted=ok)

    rows = attempts.select("key", "at_ms", "id").repartition("key").sortWithinPartitions("key", "at_ms", "id")
    return rows.mapInPandas(run, "key long, at_ms long, id long, admitted boolean")
