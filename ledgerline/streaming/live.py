"""What a display shows of a live feed, as streams with timers: the label of its link, which silence alone can change,
values that change once in a while at most, and a telemetry frame for each tick.

Event time rules: a timer goes off when the watermark has passed it, so nothing that came before it in event time is
missed, and the result is that of the batch form over the same rows. Rows behind the watermark are lost. Rows of a feed are
taken in the order of their time within a micro-batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions import scalars as S
from ..operators.replay import key_runs
from ..operators.telemetry import NO_DATA_MS, QUIET_MS
from ..schema import FEED, KEY
from .packs import PACK, given, handed, pack, packed, unpack, unpacked


@dataclass
class Link:
    """What is known of a link, and the label that was sent last."""

    link: str = "connecting"
    ever_opened: bool = False
    open_at: int = 0
    beat_at: int = 0
    view_at: int = 0
    now: int = 0
    label: str | None = None
    timer: int | None = None

    def take(self, kind: str, now: int) -> None:
        if kind in ("connecting", "open", "transient", "closed"):
            self.link = kind
        if kind == "open":
            self.ever_opened, self.open_at, self.beat_at, self.view_at = True, now, now, 0
        elif kind == "telemetry":
            self.beat_at = now
        elif kind == "view":
            self.view_at = now
        self.now = now

    def label_at(self, now: int) -> str:
        if self.link != "open":
            return "transient" if self.link == "transient" else "reconnecting" if self.link == "closed" or self.ever_opened else "connecting"
        if self.beat_at > 0 and now - self.beat_at > NO_DATA_MS:
            return "no-data"
        return "quiet" if now - (self.view_at or self.open_at) >= QUIET_MS else "live"

    def turns_at(self) -> int | None:
        """When silence may change the label next."""
        if self.link != "open":
            return None
        times = [(self.view_at or self.open_at) + QUIET_MS] + ([self.beat_at + NO_DATA_MS + 1] if self.beat_at > 0 else [])
        return min((t for t in times if t > self.now), default=None)


_STATE = "link string, ever_opened boolean, open_at bigint, beat_at bigint, view_at bigint, now bigint, label string, timer bigint"
LABELS = f"{FEED}, at_ms bigint, label string, cause string"


class LinkProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.saved = handle.getValueState("link", _STATE)

    def load(self) -> Link:
        return Link(*self.saved.get()) if self.saved.exists() else Link()

    def save(self, link: Link) -> None:
        due = link.turns_at()
        if due != link.timer:
            if link.timer is not None:
                self.handle.deleteTimer(link.timer)
            if due is not None:
                self.handle.registerTimer(due)
            link.timer = due
        self.saved.update(tuple(asdict(link)[f.name] for f in fields(Link)))

    @staticmethod
    def silence(key: Any, link: Link, until: int) -> Iterator[Row]:
        """Labels that change up to a time in which nothing happens."""
        while (t := link.turns_at()) is not None and t <= until:
            link.now = t
            if link.label_at(t) != link.label:
                link.label = link.label_at(t)
                yield Row(venue=key[0], symbol=key[1], at_ms=t, label=link.label, cause="silence")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        link = self.load()
        for r in sorted(rows, key=lambda r: (r["now_ms"], r["ord"])):
            yield from self.silence(key, link, r["now_ms"] - 1)
            link.take(r["type"], r["now_ms"])
            if link.label_at(link.now) != link.label:
                link.label = link.label_at(link.now)
                yield Row(venue=key[0], symbol=key[1], at_ms=link.now, label=link.label, cause="event")
        self.save(link)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        link = self.load()
        link.timer = None  # it is gone
        yield from self.silence(key, link, max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()))
        self.save(link)

    def close(self) -> None:
        pass


def link_labels(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Changes of the label of each feed's link, by an event or by silence: (KEY, at_ms, label, cause).

    events: a stream of link events (KEY, ord, type, now_ms) as for operators.telemetry.link_state.
    """
    rows = events.select(*KEY, "ord", "type", "now_ms", F.timestamp_millis("now_ms").alias("at")).withWatermark("at", late)
    return rows.groupBy(*KEY).transformWithState(LinkProcessor(), outputStructType=StructType.fromDDL(LABELS), outputMode="Append", timeMode="EventTime")


SHOWN = f"{FEED}, ord bigint, t_ms bigint, value string, shown_ms bigint"
#: Feeds share this many states: a state costs calls a batch, however little it holds.
GROUPS = 512


def throttle(times: list[int], gap: int, free: int | None, held: int | None) -> tuple[list[tuple[int, int]], int | None, int | None]:
    """Which of a feed's values are shown, and when, from when its slot ends and which value is held on; values are places in
    times, -1 for the one held from before. Also the slot's end and the value held after them."""
    shown = []
    for i, t in enumerate(times):
        if free is not None and t < free:
            held = i
            continue
        if held is not None:
            shown.append((held, free))
            free, held = free + gap, None
            if t < free:  # what was held began another slot
                held = i
                continue
        shown.append((i, t))
        free = t + gap
    return shown, free, held


class ThrottleProcessor(StatefulProcessor):
    """Holds of each feed of a group when its slot ends, and the value to be shown then: one value of the state, with one
    timer for the slot that ends first."""

    SLOTS = pa.schema([*[(k, pa.string()) for k in KEY], ("free", pa.int64()), ("held", pa.bool_()), ("ord", pa.int64()), ("t_ms", pa.int64()), ("value", pa.string())])
    OUT = pa.schema([*[(k, pa.string()) for k in KEY], ("ord", pa.int64()), ("t_ms", pa.int64()), ("value", pa.string()), ("shown_ms", pa.int64())])

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.saved = handle.getValueState("slots", "slots binary, timer bigint, seen bigint")

    def load(self) -> tuple[dict, int | None, int]:
        """Slots by feed (free, held, and the held row's ord, t_ms and value), the timer, and how far the clock was."""
        saved = self.saved.get()
        if saved is None:
            return {}, None, 0
        columns = [c.to_pylist() for c in unpack(saved[0]).columns]
        return {tuple(x[: len(KEY)]): tuple(x[len(KEY) :]) for x in zip(*columns)}, saved[1], saved[2]

    def save(self, slots: dict, timer: int | None, seen: int) -> None:
        due = min((free for free, held, *_ in slots.values() if held), default=None)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.saved.update((pack(self.table([(*key, *slot) for key, slot in slots.items()], self.SLOTS)), due, seen))

    @staticmethod
    def table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
        columns = list(zip(*rows)) if rows else [()] * len(schema)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        slots, timer, seen = self.load()
        log = given(rows)
        if seen:
            log = log.filter(pc.greater(log.column("t_ms"), seen))
        if log.num_rows:
            log = log.sort_by([(c, "ascending") for c in (*KEY, "t_ms", "ord")]).combine_chunks()
            times, early, places, at = log.column("t_ms").to_pylist(), [], [], []
            for a, b, feed in key_runs(log, KEY):
                free, is_held, *value = slots.get(feed, (None, False))
                shown, free, held = throttle(times[a:b], self.gap, free, -1 if is_held else None)
                if shown and shown[0][0] < 0:
                    early.append((*feed, *value, shown.pop(0)[1]))
                places += [a + i for i, _ in shown]
                at += [t for _, t in shown]
                if held is None:
                    slots[feed] = (free, False, None, None, None)
                else:
                    slots[feed] = (free, True, *(value if held < 0 else [log.column(c)[a + held].as_py() for c in ("ord", "t_ms", "value")]))
            taken = log.select(self.OUT.names[:-1]).take(pa.array(places, pa.int64())).append_column("shown_ms", pa.array(at, pa.int64())).cast(self.OUT)
            yield from handed(pa.concat_tables([self.table(early, self.OUT), taken]), {})
        self.save(slots, timer, max(seen, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        slots, _, seen = self.load()
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        ended = {feed: slot for feed, slot in slots.items() if slot[1] and slot[0] <= until}
        for feed, (free, *_) in ended.items():
            slots[feed] = (free + self.gap, False, None, None, None)
        if ended:
            yield from handed(self.table([(*feed, *value, free) for feed, (free, _, *value) in ended.items()], self.OUT), {})
        self.save(slots, None, max(seen, until))  # the timer is gone

    def close(self) -> None:
        pass


def throttled_stream(rows: DataFrame, gap_ms: int, late: str = "0 seconds", groups: int = GROUPS) -> DataFrame:
    """What a display shows that changes once in gap_ms at most, as operators.views.throttled: (KEY, ord, t_ms, value,
    shown_ms), from a stream of (KEY, ord, t_ms, value). A held value is shown once the watermark passes the slot's end.

    Feeds are dealt to groups, each with one state and one timer, and their rows come and go in packs: a pack behind the
    watermark is lost, and so is a row behind the watermark that its group saw last.
    """
    group = F.pmod(F.xxhash64(*KEY), F.lit(groups)).alias("group")
    timed = packed(rows.select(group, *KEY, "ord", "t_ms", F.col("value").cast("string").alias("value")), ["group"], "t_ms")
    timed = timed.withColumn("at", F.timestamp_millis("t_ms")).withWatermark("at", late)
    out = timed.groupBy("group").transformWithState(ThrottleProcessor(gap_ms), outputStructType=StructType.fromDDL(PACK), outputMode="Append", timeMode="EventTime")
    return unpacked(out, [], SHOWN)


#: The newest fault events that a telemetry frame lists.
LISTED = 16
_EVENT = "struct<id:bigint,kind:string,at_ms:bigint,expected_seq:bigint,got_seq:bigint,reason:string,duration_ms:bigint>"
_FIELDS = ("id", "kind", "at_ms", "expected_seq", "got_seq", "reason", "duration_ms")
FRAMES = f"{FEED}, tick_ms bigint, seq bigint, gaps bigint, resyncs bigint, disconnects bigint, would_crosses bigint, events array<{_EVENT}>"


_COUNTS = ("gaps", "resyncs", "disconnects", "would_crosses")
#: Parts of ticks: counts and the newest sequence of some rows of a tick, or one fault event of it.
PARTS = f"{FEED}, tick_ms bigint, at_ms bigint, seq bigint, {', '.join(f'{c} bigint' for c in _COUNTS)}, e {_EVENT}"
#: Parts that a task holds before it hands them on.
PARTS_HELD = 65_536


def merged(parts: pa.Table) -> pa.Table:
    """One row of counts for each feed and tick, and its newest LISTED events."""
    keys = [*KEY, "tick_ms"]
    sums = parts.group_by(keys).aggregate([("at_ms", "max"), ("seq", "max"), *[(c, "sum") for c in _COUNTS]])
    sums = sums.select([*keys, "at_ms_max", "seq_max", *[f"{c}_sum" for c in _COUNTS]]).rename_columns([*keys, "at_ms", "seq", *_COUNTS])
    sums = sums.append_column("e", pa.nulls(len(sums), parts.schema.field("e").type)).cast(parts.schema)
    listed = parts.filter(pc.is_valid(parts.column("e")))
    if not len(listed):
        return sums
    ids = pc.struct_field(listed.column("e"), "id")
    order = pc.sort_indices(listed.select(keys).append_column("id", ids), [*[(k, "ascending") for k in keys], ("id", "descending")])
    listed = listed.take(order)
    starts = np.array([a for a, _, _ in key_runs(listed, keys)])
    rank = np.arange(len(listed)) - np.repeat(starts, np.diff([*starts, len(listed)]))
    listed = listed.filter(pa.array(rank < LISTED))
    for c in _COUNTS:  # they are in the sums
        listed = listed.set_column(listed.schema.get_field_index(c), c, pa.array(np.zeros(len(listed), np.int64)))
    return pa.concat_tables([sums, listed.cast(parts.schema)])


def tick_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task in few parts, for a feed's state to take up."""
    held, n = [], 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        n += batch.num_rows
        if n > PARTS_HELD:
            held = [merged(pa.concat_tables(held))]
            n = len(held[0])
            if n > PARTS_HELD // 2:
                yield from held[0].to_batches()
                held, n = [], 0
    if n:
        yield from merged(pa.concat_tables(held)).to_batches()


class TickProcessor(StatefulProcessor):
    """Counts and the newest LISTED faults of each tick that is still open; a tick is sent and forgotten when it has passed."""

    def __init__(self, tick_ms: int):
        self.tick = tick_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("ticks", "tick_ms bigint", "seq bigint, gaps bigint, resyncs bigint, disconnects bigint, would_crosses bigint, events string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        ticks: dict[int, list] = {}
        for r in rows:
            at = r["tick_ms"]
            if at not in ticks:
                if self.open.containsKey((at,)):
                    *counts, events = self.open.getValue((at,))
                    ticks[at] = [*counts, json.loads(events)]
                else:
                    ticks[at] = [None, 0, 0, 0, 0, []]
                    self.handle.registerTimer(at + self.tick)
            t = ticks[at]
            if r["seq"] is not None and (t[0] is None or r["seq"] > t[0]):
                t[0] = r["seq"]
            for i, c in enumerate(_COUNTS, start=1):
                t[i] += r[c]
            if r["e"] is not None:
                t[5].append([r["e"][c] for c in _FIELDS])
                if len(t[5]) >= 2 * LISTED:
                    t[5] = sorted(t[5], key=lambda e: e[0], reverse=True)[:LISTED]
        for at, (*counts, events) in ticks.items():
            self.open.updateValue((at,), (*counts, json.dumps(sorted(events, key=lambda e: e[0], reverse=True)[:LISTED])))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs() - self.tick
        seq, gaps, resyncs, disconnects, crosses, events = self.open.getValue((at,))
        self.open.removeKey((at,))
        listed = [Row(**dict(zip(_FIELDS, e))) for e in json.loads(events)]
        yield Row(venue=key[0], symbol=key[1], tick_ms=at, seq=seq, gaps=gaps, resyncs=resyncs, disconnects=disconnects, would_crosses=crosses, events=listed)

    def close(self) -> None:
        pass


def telemetry_stream(faults: DataFrame, views: DataFrame, tick_ms: int = 1000, late: str = "10 seconds") -> DataFrame:
    """A frame of each feed for every tick in which something happened, once the watermark has passed it: faults by kind,
    the newest view's sequence and the last LISTED fault events of that tick, newest first.

    faults: streams of KEY, id, kind, at_ms and the other fault columns; views: KEY, at_ms, last_seq. A view of no feed (null)
    moves the clock on, for the ticks before it to be sent. Rows of a tick meet in parts within the tasks that read them,
    so that a feed's state takes up few rows; a part behind the watermark is lost. Running counters are sums over ticks.
    """
    event = F.struct(*_FIELDS)
    f = faults.select(*KEY, "at_ms", event.cast(_EVENT).alias("e"), F.lit(None).cast("bigint").alias("seq"))
    v = views.select(*KEY, "at_ms", F.lit(None).cast(_EVENT).alias("e"), F.col("last_seq").alias("seq"))
    kinds = zip(_COUNTS, (("gap",), S.REBUILD_KINDS, ("disconnect",), ("cross",)))
    counts = [F.coalesce(F.col("e.kind").isin(*names).cast("bigint"), F.lit(0)).cast("bigint").alias(c) for c, names in kinds]
    tick = (F.col("at_ms") - F.pmod("at_ms", F.lit(tick_ms))).cast("bigint").alias("tick_ms")
    rows = f.unionByName(v).select(*KEY, tick, "at_ms", "seq", *counts, "e").mapInArrow(tick_parts, PARTS)
    rows = rows.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", late)
    return rows.groupBy(*KEY).transformWithState(TickProcessor(tick_ms), outputStructType=StructType.fromDDL(FRAMES), outputMode="Append", timeMode="EventTime")
