"""State processors of the keyed stream operators (K2, K5, K6, K8).

A key's rows of a micro-batch arrive in frames of at most
``spark.sql.execution.arrow.maxRecordsPerBatch`` rows in no particular order.
``in_order`` hands them on in event order while it holds about one frame: a
single frame is sorted; several are cut at quantiles of the first into slices,
which wait in the state store and come back one after the other. So no key's
micro-batch is ever whole in memory, and the results do not depend on how a
micro-batch was dealt. (Spark hands the rows on under names that must not begin
with an underscore.)

Expiry is event time: an event later than the time to live after the key's
previous one finds the value gone; a timer drops the state itself once the
watermark has passed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
SLICES = 256  # parts that a key's micro-batch of several frames is cut into


def with_state(rows: DataFrame, keys: list[str], processor: StatefulProcessor, out: str | T.StructType, mode: str = "append",
               event_time: str | None = None) -> DataFrame:
    """``processor`` over the rows of each key, with event-time timers.
    ``event_time`` names the time column of the rows it gives, where another
    stateful operator follows. These operators need Spark's RocksDB state store;
    it is set on the session where no provider is named."""
    conf = rows.sparkSession.conf
    if conf.get(PROVIDER).endswith("HDFSBackedStateStoreProvider"):
        conf.set(PROVIDER, ROCKSDB)
    more = {"eventTimeColumnName": event_time} if event_time else {}
    return rows.groupBy(*keys).transformWithStateInPandas(processor, out, mode, "eventTime", **more)


def _packed(df: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pandas(df, preserve_index=False)
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


def in_order(frames: Iterator[pd.DataFrame], by: list[str], spill) -> Iterator[pd.DataFrame]:
    """The rows of ``frames`` as frames in the order of the columns ``by``, the
    first of which is a number. ``spill``: a map state (slice, frame) -> rows."""
    frames = (f for f in frames if len(f))
    first, second = next(frames, None), next(frames, None)
    if first is None:
        return
    if second is None:
        yield first.sort_values(by, kind="stable", ignore_index=True)
        return
    cuts = np.unique(np.quantile(first[by[0]].to_numpy(), np.linspace(0, 1, SLICES + 1)[1:-1]))
    held: dict[int, list[int]] = {}
    for n, frame in enumerate(chain((first, second), frames)):
        for part, rows in frame.groupby(np.searchsorted(cuts, frame[by[0]].to_numpy(), side="right")):
            spill.updateValue((int(part), n), (_packed(rows),))
            held.setdefault(int(part), []).append(n)
    for part in sorted(held):
        rows = pd.concat([_unpacked(spill.getValue((part, n))[0]) for n in held[part]], ignore_index=True)
        for n in held[part]:
            spill.removeKey((part, n))
        yield rows.sort_values(by, kind="stable", ignore_index=True)


class Expiring(StatefulProcessor):
    """A processor whose keys keep one record (``fields``, the time of the last
    event first) and forget it ``ttl_ms`` after that event."""

    fields: str

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", f"last_ms long, {self.fields}" if self.fields else "last_ms long")
        self.spill = handle.getMapState("spill", "part int, frame int", "rows binary")

    def keep(self, record: tuple, watermark_ms: int) -> None:
        """Set the record, and a timer for when it is out of date (for a late
        event just past the watermark)."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.kept.update(record)
        self.handle.registerTimer(max(record[0] + self.ttl_ms, watermark_ms) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget()
        return iter(())

    def forget(self) -> None:
        self.kept.clear()

    def segments(self, ms: np.ndarray, last: int | None) -> np.ndarray:
        """0 where an event continues what is kept, k > 0 after the k-th gap over
        the time to live; without anything kept the first event is such a gap."""
        before = np.concatenate(([ms[0] if last is None else last], ms[:-1]))
        new = ms - before > self.ttl_ms
        new[0] |= last is None
        return np.cumsum(new)

    def close(self) -> None:
        pass


class RunningLength(Expiring):
    """Every event with its number since the key's last gap, as ``session_length``."""

    fields = "length long"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, length = self.kept.get() if self.kept.exists() else (None, 0)
        for df in in_order(rows, ["at_ms", "timestamp", "event_id"], self.spill):
            ms = df["at_ms"].to_numpy(np.int64)
            seg = self.segments(ms, last)
            first = np.searchsorted(seg, seg)  # place of the segment's first event
            number = np.arange(len(seg)) - first + 1 + np.where(seg == 0, length, 0)
            last, length = int(ms[-1]), int(number[-1])
            yield df.drop(columns="at_ms").assign(session_length=number)
        if last is not None:
            self.keep((last, length), timerValues.getCurrentWatermarkInMs())


class LatestSegment(Expiring):
    """A processor with one map entry per name, emptied at a gap: only entries
    that a micro-batch names are written."""

    fields = ""
    entry: str
    order: list[str]

    def init(self, handle) -> None:
        super().init(handle)
        self.entries = handle.getMapState("entries", "name string", self.entry)

    def forget(self) -> None:
        super().forget()
        self.entries.clear()

    def fold(self, rows, timerValues) -> bool:
        """Take in a key's rows; False if there were none."""
        last = self.kept.get()[0] if self.kept.exists() else None
        seen = False
        for df in in_order(rows, self.order, self.spill):
            ms = df["at_ms"].to_numpy(np.int64)
            seg = self.segments(ms, last)
            if seg[-1]:
                self.entries.clear()
            self.merge(df[seg == seg[-1]])  # what came before the last gap is gone
            last, seen = int(ms[-1]), True
        if seen:
            self.keep((last,), timerValues.getCurrentWatermarkInMs())
        return seen

    def merge(self, df: pd.DataFrame) -> None:
        raise NotImplementedError


class Affinity(LatestSegment):
    """Sum of weights per category of a user; all of the user's sums go on."""

    entry, order = "score double", ["at_ms", "timestamp", "event_id"]

    def merge(self, df) -> None:
        for name, w in df.groupby("category", sort=False)["weight"].sum().items():
            old = self.entries.getValue((name,))[0] if self.entries.containsKey((name,)) else 0.0
            self.entries.updateValue((name,), (old + float(w),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.fold(rows, timerValues):
            found = sorted((k[0], v[0]) for k, v in self.entries.iterator())
            yield pd.DataFrame({"user_id": [key[0]] * len(found), "category": [c for c, _ in found], "score": [s for _, s in found]})


class CompetitorRange(LatestSegment):
    """Latest price per competitor of a product (arrival order), and their range."""

    entry, order = "price double", ["seq", "timestamp", "value"]

    def merge(self, df) -> None:
        for name, price in df.drop_duplicates("competitor", keep="last")[["competitor", "value"]].itertuples(index=False):
            self.entries.updateValue((name,), (float(price),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.fold(rows, timerValues):
            prices = [v[0] for _, v in self.entries.iterator()]
            yield pd.DataFrame({"product_id": [key[0]], "min": [min(prices)], "max": [max(prices)], "n_competitors": [len(prices)]})


class Lookup(Expiring):
    """Requests with the value of the key's latest update. Rows are updates
    (``is_request`` false, which carry ``names``) or requests; an update reaches
    the requests after it, for as long as it is not out of date."""

    def __init__(self, ttl_ms: int, names: list[str], columns: list[str]):
        super().__init__(ttl_ms)
        self.names, self.columns, self.fields = names, columns, ", ".join(f"{n} double" for n in names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        record = self.kept.get() if self.kept.exists() else None
        fresh = False
        for df in in_order(rows, ["at_ms", "is_request", "event_id"], self.spill):
            update = ~df["is_request"].to_numpy(bool)
            at = np.maximum.accumulate(np.where(update, np.arange(len(df)), -1))  # the latest update of each row
            known = df[["at_ms", *self.names]].to_numpy(np.float64, na_value=np.nan)
            if record is not None:  # what was kept stands before the first row
                known = np.vstack((known, [np.nan if x is None else x for x in record]))
            value = known[at] if record is not None else np.where((at >= 0)[:, None], known[at], np.nan)
            value[~(df["at_ms"].to_numpy(np.float64) - value[:, 0] <= self.ttl_ms)] = np.nan
            if update.any():
                last = known[np.flatnonzero(update)[-1]]
                record = (int(last[0]), *(None if np.isnan(x) else float(x) for x in last[1:]))
                fresh = True
            out = df[~update].copy()
            for k, name in enumerate(self.names):
                out[name] = value[~update, 1 + k]
            if len(out):
                yield out[self.columns]
        if fresh:
            self.keep(record, timerValues.getCurrentWatermarkInMs())


class PriceCache(Expiring):
    """Requests with the price computed for their key less than ``ttl_ms``
    before, if there is one: ``final_price``, ``reason`` and ``cache_hit``."""

    fields = "final_price double, reason string"

    def __init__(self, ttl_ms: int, columns: list[str]):
        super().__init__(ttl_ms)
        self.columns = columns

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        record = self.kept.get() if self.kept.exists() else None
        for df in in_order(rows, ["at_us", "event_id"], self.spill):
            us, price, reason = df["at_us"].to_numpy(np.int64), df["final_price"].to_numpy(np.float64).copy(), df["reason"].to_numpy(object).copy()
            hit = np.zeros(len(df), bool)
            i = 0
            while i < len(us):  # a step for each price computed
                if record is None or us[i] >= record[0] + self.ttl_ms * 1000:
                    record = (int(us[i]), float(price[i]), reason[i])
                    start = i + 1
                else:
                    start = i
                i = int(np.searchsorted(us, record[0] + self.ttl_ms * 1000))
                i = max(i, start)
                price[start:i], reason[start:i], hit[start:i] = record[1], record[2], True
            yield df.assign(final_price=price, reason=reason, cache_hit=hit)[self.columns]
        if record is not None:
            self.keep(record, timerValues.getCurrentWatermarkInMs())

    def keep(self, record, watermark_ms) -> None:  # the record's time is in microseconds
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.kept.update(record)
        self.handle.registerTimer(max(record[0] // 1000 + self.ttl_ms, watermark_ms) + 1)
