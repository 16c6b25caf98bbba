"""The replay as a stream: keyed state for each feed, in RocksDB, with the same fold as the batch job.

Rows of a key arrive in any order within a micro-batch and are sorted by arrival there; arrivals must not fall from one
batch to the next. A fault whose rebuild ends in a later batch is sent again under its id with its duration: the last
row of an id counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import replace
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import MapState
from pyspark.sql.types import StructType

from ..operators import replay as R
from ..operators.replay import OUT, Fold, Options, log_rows, output
from ..schema import FEED, KEY
from .packs import PACK, given, handed, packed, unpacked

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def event_of(r: Row) -> R.Row:
    """A row of the log for the fold; numbers stay whole, null ones count as 0."""
    level = lambda side: [(x["price"], x["size"]) for x in side or []]
    return R.Row(r["kind"], r["arrival"] or 0, (r["received_ns"] or 0) // 1_000_000, r["first_seq"] or 0, r["last_seq"] or 0, level(r["bids"]), level(r["asks"]), r["checksum"], r["error"])


#: A row of the log in the state, without its feed; levels as text, which the state takes as one value.
LOG_ROW = "kind string, arrival bigint, ms bigint, first_seq bigint, last_seq bigint, bids string, asks string, checksum bigint, error string"


def stored(r: R.Row) -> tuple:
    return (r.kind, r.arrival, r.ms, r.first_seq, r.last_seq, json.dumps(r.bids), json.dumps(r.asks), r.checksum, r.error)


def fetched(r: Row) -> R.Row:
    kind, arrival, ms, first, last, bids, asks, checksum, error = r
    levels = lambda text: [(p, s) for p, s in json.loads(text)]
    return R.Row(kind, arrival, ms, first, last, levels(bids), levels(asks), checksum, error)


class StateQueue:
    """Snapshots that wait for a fetch, in a map of the state from their number: one is read when it is fetched."""

    def __init__(self, state: MapState, head: int, tail: int):
        self.state, self.head, self.tail = state, head, tail

    def __bool__(self) -> bool:
        return self.head < self.tail

    def append(self, row: R.Row) -> None:
        self.state.updateValue((self.tail,), stored(row))
        self.tail += 1

    def popleft(self) -> R.Row:
        row = fetched(self.state.getValue((self.head,)))
        self.state.removeKey((self.head,))
        self.head += 1
        return row


#: Rows of a pack that are taken out of Arrow's columns at a time.
DECODED = 8192


def one_by_one(rows: Iterable[Row]) -> tuple[int | None, Iterable[tuple[bool, R.Row]]]:
    """A batch's window, and its rows in order with whether they are queued; rows of the fold at once, as those of Spark take
    several times their memory."""
    fresh = sorted(((r["arrival"] or 0, r["sub"] or 0, r["queued"], r["max_depth"], event_of(r)) for r in rows), key=lambda r: r[:2])
    return next((r[3] for r in fresh if r[3] is not None), None), ((r[2], r[4]) for r in fresh)


def in_columns(table: pa.Table) -> tuple[int | None, Iterable[tuple[bool, R.Row]]]:
    """The same of a table, some rows at a time."""
    number = lambda c: pc.fill_null(table.column(c), 0).to_numpy()
    order = np.lexsort((number("sub"), number("arrival")))
    windows = table.column("max_depth").take(pa.array(order)).drop_null()
    parts = (table.take(pa.array(order[a : a + DECODED])) for a in range(0, len(order), DECODED))
    return windows[0].as_py() if len(windows) else None, (x for part in parts for x in zip(part.column("queued").to_pylist(), R.rows_of(part)))


#: A book of so many levels is one value of the state with the numbers; a larger one is in maps.
SMALL = 64


class ReplayProcessor(StatefulProcessor):
    """Folds a feed's rows batch by batch.

    The state is a few numbers, with the levels of the book while they are few; else a map from price to size for each side
    of the book, of which a batch writes the levels that it changed; snapshots that wait for a fetch, each by its number;
    and, for the policy `queue`, the rows that came before the first snapshot, however many. packs: hands on rows in packs.
    """

    def __init__(self, options: Options, packs: bool = False):
        self.options, self.packs = options, packs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.saved = handle.getValueState("numbers", "value string")
        self.sides = {name: [handle.getMapState(f"{name}_{side}", "price bigint", "size bigint") for side in ("bids", "asks")] for name in ("book", "truth")}
        self.snapshots = handle.getMapState("snapshots", "at bigint", LOG_ROW)
        self.waiting = handle.getListState("waiting", LOG_ROW)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        level = lambda side: None if side is None else [Row(price=x["price"], size=x["size"]) for x in side]
        for table in self.folded(key, rows):
            if self.packs:
                yield from handed(table.drop_columns(KEY), dict(zip(KEY, key)))
                continue
            for r in table.to_pylist():
                yield Row(**(r | {"bids": level(r["bids"]), "asks": level(r["asks"])}))

    @staticmethod
    def events(fold: Fold, fresh: Iterable[tuple[bool, R.Row]]) -> Iterator[R.Row]:
        """Rows that do not wait for a fetch; the others go to the fold's queue."""
        for queued, row in fresh:
            if queued:
                fold.queue.append(row)
            else:
                yield row

    def folded(self, key: Any, rows: Iterator[Row]) -> Iterator[pa.Table]:
        rows = iter(rows)
        first = next(rows)
        rows = chain([first], rows)
        widest, fresh = in_columns(given(rows)) if hasattr(first, "pack") else one_by_one(rows)
        saved = self.saved.get()
        numbers = json.loads(saved[0]) if saved is not None else {"started": False, "head": 0, "tail": 0, "window": widest, "small": {"book": [[], []], "truth": [[], []]}}
        window, started, small = numbers["window"], numbers["started"], numbers["small"]
        fold = Fold(self.options if window is None else replace(self.options, max_depth=window))
        if "fold" in numbers:
            fold.restore(numbers["fold"])
        before = {}
        for name, states in self.sides.items():
            if name == "book" or self.options.policy == "as_of":
                before[name] = [dict(side) for side in small[name]] if name in small else [{k[0]: v[0] for k, v in state.iterator()} for state in states]
                for side, levels in enumerate(before[name]):
                    for price, size in levels.items():
                        getattr(fold, name).set(side, price, size)
        fold.queue = StateQueue(self.snapshots, numbers["head"], numbers["tail"])
        carried, gen = fold.open_fault, fold.gen
        due = self.events(fold, fresh)
        if self.options.policy == "queue":
            due = list(due)  # a fetch may take a snapshot that came with later rows
        if started or fold.queue or self.options.policy != "queue":
            held = []
            if self.options.policy == "queue" and self.waiting.exists():
                held = [fetched(r) for r in self.waiting.get()]
                self.waiting.clear()
            for row in chain(held, due):
                if not started and row.kind != "truth":
                    fold.start(row)
                    started = True
                fold.step(row)
                if len(fold.views) >= R.VIEWS_A_BATCH:
                    yield output(fold, *key, 0, closing=False)
                    fold.views, fold.faults = [], [f for f in fold.faults if f is fold.open_fault]
        elif due:  # a list, as the policy is queue
            self.waiting.appendList([stored(r) for r in due])
        if carried is not None and carried[6] != -1:
            fold.faults.append(carried)
        fold.kept = fold.kept or fold.gen == gen
        for name, sides in before.items():
            now = getattr(fold, name).sizes
            if name in small and sum(map(len, now)) <= SMALL:
                small[name] = [list(side.items()) for side in now]
                continue
            if small.pop(name, None) is not None:
                sides = [{}, {}]
            for state, old, new in zip(self.sides[name], sides, now):
                for price, size in new.items():
                    if old.get(price) != size:
                        state.updateValue((price,), (size,))
                for price in old.keys() - new.keys():
                    state.removeKey((price,))
        self.saved.update((json.dumps({"fold": fold.state(), "started": started, "head": fold.queue.head, "tail": fold.queue.tail, "window": window, "small": small}),))
        yield output(fold, *key, 0)

    def close(self) -> None:
        pass


def replay_stream(events: DataFrame, snapshots: DataFrame | None = None, options: Options = Options(), instruments: DataFrame | None = None, hot: bool = False) -> DataFrame:
    """Streaming replay of feed_events (and of a stream of snapshots): rows as of operators.replay.replay, in append
    mode. The closing row of each batch holds the counters and the status so far.

    instruments: a table of windows of feeds (KEY, max_depth) where they differ from the options'; a feed keeps the window
    of its first batch. hot: feeds are few and their rows many, which then reach the state in packs.
    """
    rows = log_rows(events, snapshots)
    if instruments is None:
        rows = rows.withColumn("max_depth", F.lit(None).cast("int"))
    else:
        rows = rows.join(instruments.select(*KEY, F.col("max_depth").cast("int").alias("max_depth")), KEY, "left")
    if hot:
        rows = packed(rows, KEY)
    out = rows.groupBy(*KEY).transformWithState(ReplayProcessor(options, packs=True), outputStructType=StructType.fromDDL(f"{FEED}, {PACK}"), outputMode="Append", timeMode="None")
    return unpacked(out, KEY, OUT)


def latest_views_stream(views: DataFrame) -> DataFrame:
    """The newest view of each feed after every micro-batch, for update mode: a consumer that is slow gets the last one."""
    other = [c for c in views.columns if c not in (*KEY, "gen")]
    return views.groupBy(*KEY).agg(F.max("gen").alias("gen"), F.max_by(F.struct(*other), "gen").alias("view"))
