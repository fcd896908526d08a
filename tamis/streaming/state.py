"""State per key: a queue whose entries change, counted from the changes alone."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DataType, IntegralType

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 4096
NO_STAMP = -(1 << 63)  # older than all others


class _Latest(StatefulProcessor):
    """The newest entries of a bucket of keys, as JSON lists [key, order, tie, marks]; sends what their flags add to and take from the
    counts. The first mark says whether an entry is closed, the others are its flags. A closed entry goes once the watermark has passed
    its time, unless it opens again before. `due` is the bucket's timer: the first time a closed entry can go."""

    def __init__(self, flags: Sequence[str]):
        self.flags = list(flags)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "due bigint, entries string")

    def _stored(self) -> tuple[int | None, dict]:
        old = self.entry.get()
        return (old[0], {e[0]: e[1:] for e in json.loads(old[1])}) if old is not None else (None, {})

    def _store(self, entries: dict) -> int | None:
        due = min((d for e in entries.values() if (d := _due(e)) is not None), default=None)
        self.entry.update((due, json.dumps([[k, *e] for k, e in entries.items()], separators=(",", ":"))))
        return due

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before, entries = self._stored()
        change, new = [0] * len(self.flags), False
        for r in rows:
            name, at, tie, marks = json.loads(r[2])
            entry, old = [NO_STAMP if at is None else int(at), tie, marks], entries.get(name)
            if old is not None and old[:2] >= entry[:2]:
                continue
            entries[name], new = entry, True
            for i in range(len(change)):
                change[i] += (marks[i + 1] == "1") - (old is not None and old[2][i + 1] == "1")
        if not new:
            return
        due = self._store(entries)
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)
        if any(change):
            yield Row(**dict(zip(self.flags, change, strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)  # a timer ends below the watermark
        entries = {k: e for k, e in self._stored()[1].items() if (d := _due(e)) is None or d > passed}
        if not entries:
            self.entry.clear()
        elif (due := self._store(entries)) is not None:
            self.handle.registerTimer(due)
        return iter(())

    def close(self) -> None:
        pass


def _due(entry: Sequence) -> int | None:
    """When an entry can go; never while it is open or without a stamp."""
    return entry[0] // 1000 + 1 if entry[2][0] == "1" and entry[0] != NO_STAMP else None


def _bucket(key: Column, kind: DataType, buckets: int) -> Column:
    """Keys that are whole numbers below `buckets` are their own bucket, all others are dealt by hash."""
    dealt = F.pmod(F.xxhash64(key), F.lit(buckets))
    if not isinstance(kind, IntegralType):
        return dealt
    return F.when((key >= 0) & (key < buckets), key.cast("bigint")).otherwise(dealt)


def count_changes(stream: DataFrame, key: str, stamp: str, tie: Column, closed: Column, flags: dict[str, Column], hold: str,
                  buckets: int = BUCKETS) -> DataFrame:
    """Changes of the counts in `flags` (name: condition) as keyed entries arrive in any order; summed over all batches they are the
    counts over the newest row of each key by (`stamp`, `tie`). Null keys are equal.

    Entries are kept in `buckets` of keys, each one value of the state store, as a call of the store and a result cost Python far more than
    an entry: a batch reads and writes the buckets of its own keys. Choose `buckets` so that one holds a few hundred keys; the number is
    fixed for the life of a checkpoint.

    Open entries are kept for good. A closed one is forgotten `hold` behind the newest stamp; a change that arrives later than that
    against the stamps already seen is late and left out, so `hold` is the longest delay that still counts. Null stamps are the
    oldest, never late and kept; null flags count as false. Start it with `state_store(spark)`."""
    mark = F.concat(*[F.when(F.coalesce(c, F.lit(False)), "1").otherwise("0") for c in (closed, *flags.values())])
    entries = stream.withWatermark(stamp, hold).select(
        _bucket(F.col(key), stream.schema[key].dataType, buckets).alias(key), F.col(stamp),  # one text a row: each column costs Python as much
        F.to_json(F.array(F.col(key).cast("string"), F.unix_micros(stamp).cast("string"), F.coalesce(tie.cast("string"), F.lit("")), mark)).alias("_entry"))
    return entries.groupBy(key).transformWithState(
        _Latest(list(flags)), ", ".join(f"{name} int" for name in flags), "Append", "EventTime")


class state_store:
    """The store that state processors need, set while their query starts and runs."""

    def __init__(self, spark):
        self.conf = spark.conf

    def __enter__(self):
        self.before = self.conf.get(STATE_STORE, None)
        self.conf.set(STATE_STORE, ROCKSDB)

    def __exit__(self, *error):
        self.conf.set(STATE_STORE, self.before) if self.before is not None else self.conf.unset(STATE_STORE)
