"""Replay of a feed: snapshots and events in, views, faults, counters and a final status out.

This is the one job that Spark's aggregates cannot express: whether an update applies depends on the book after all
before it. One ordered fold a feed over Arrow batches, which holds the book and one batch, not the feed; a feed whose
snapshots are in its log is folded a segment at a time, so that a hot feed runs in parallel, and the parts are stitched
by window functions.

Snapshot policies: `queue` (the k-th fetch takes the k-th snapshot), `in_log` (snapshot rows are events), `as_of` (a
fetch takes the true book, kept from `truth` rows of the log, at the cost of the levels that differ since the last fetch).
A feed that ends early gets a status, never an error.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import COUNTER_NAMES, KEY, LEVELS
from ..shared import written
from .scans import LAST, SUM, running

Levels = list[tuple[int, int]]
#: A fold hands on its views when it has so many.
VIEWS_A_BATCH = 1000
#: So many waiting snapshots are taken out of Arrow's columns at a time.
DECODED = 16


@dataclass(frozen=True)
class Options:
    depth: int = 10
    max_depth: int = 0  # 0: full book
    policy: str = "queue"
    checksum: str | None = None  # None, "crc32" or "sum" (price and size added, for tests)
    bind_attempts: int = 8
    transient_retries: int = 5
    resync_limit: int = 16
    fetch_ms: int = 0  # added to the clock by every fetch
    views_every: int = 1  # 0: no views, only the last one

    def __post_init__(self) -> None:
        if self.checksum and 0 < self.max_depth < 10:
            raise ValueError("a window must hold the ten levels that a checksum covers")


def crc_checksum(bids: Levels, asks: Levels) -> int:
    return zlib.crc32("".join(f"{p}{s}" for side in (asks, bids) for p, s in side).encode())


def sum_checksum(bids: Levels, asks: Levels) -> int:
    return sum(p + s for side in (bids, asks) for p, s in side)


CHECKSUMS: dict[str, Callable[[Levels, Levels], int]] = {"crc32": crc_checksum, "sum": sum_checksum}


class Book:
    """Two maps of price to size with their prices in order; of levels given twice the last one counts."""

    def __init__(self, bids: Iterable[tuple[int, int]] = (), asks: Iterable[tuple[int, int]] = ()) -> None:
        bid, ask = ({p: s for p, s in dict(side).items() if s} for side in (bids, asks))
        self.sizes: tuple[dict[int, int], dict[int, int]] = (bid, ask)
        self.prices: tuple[list[int], list[int]] = (sorted(bid), sorted(ask))

    def set(self, side: int, price: int, size: int) -> None:
        sizes, prices = self.sizes[side], self.prices[side]
        if size:
            if price not in sizes:
                insort(prices, price)
            sizes[price] = size
        elif price in sizes:
            del sizes[price]
            del prices[bisect_left(prices, price)]

    def apply(self, bids: Levels, asks: Levels) -> None:
        for price, size in bids:
            self.set(0, price, size)
        for price, size in asks:
            self.set(1, price, size)

    def truncate(self, n: int) -> None:
        """Only the n best of each side stay; 0 keeps all."""
        if n:
            for side, worst in ((0, 0), (1, -1)):
                while len(self.prices[side]) > n:
                    del self.sizes[side][self.prices[side].pop(worst)]

    def crossed(self) -> bool:
        bids, asks = self.prices
        return bool(bids and asks and bids[-1] >= asks[0])

    def top(self, n: int) -> tuple[Levels, Levels]:
        bids, asks = self.prices
        best = bids[: -n - 1 : -1] if n < len(bids) else bids[::-1]
        return [(p, self.sizes[0][p]) for p in best], [(p, self.sizes[1][p]) for p in asks[:n]]


class NotedBook(Book):
    """A book that notes the prices written to it, so that it can follow another one at the cost of what changed."""

    def __init__(self, bids: Iterable[tuple[int, int]] = (), asks: Iterable[tuple[int, int]] = ()) -> None:
        super().__init__(bids, asks)
        self.noted: tuple[set[int], set[int]] | None = None  # None: any may have changed

    def set(self, side: int, price: int, size: int) -> None:
        super().set(side, price, size)
        if self.noted is not None:
            self.noted[side].add(price)

    def apply(self, bids: Levels, asks: Levels) -> None:
        super().apply(bids, asks)
        if self.noted is not None and sum(map(len, self.noted)) > sum(map(len, self.prices)):
            self.noted = None  # a copy costs no more, and notes stay as few as levels

    def follow(self, other: NotedBook) -> None:
        """Takes the levels of other: those that either wrote since the last time, or a copy if they are not known."""
        if self.noted is None or other.noted is None:
            (bid, ask), (bids, asks) = other.sizes, other.prices
            self.sizes, self.prices = (dict(bid), dict(ask)), (list(bids), list(asks))
        else:
            for side, (own, its) in enumerate(zip(self.noted, other.noted)):
                for price in own | its:
                    super().set(side, price, other.sizes[side].get(price, 0))
        self.noted, other.noted = (set(), set()), (set(), set())


def raw_crossed(bids: Levels, asks: Levels) -> bool:
    return bool(bids and asks and max(p for p, _ in bids) >= min(p for p, _ in asks))


@dataclass(slots=True)
class Row:
    """An event, a snapshot or a truth row of a feed."""

    kind: str
    arrival: int = 0
    ms: int = 0
    first_seq: int = 0
    last_seq: int = 0
    bids: Levels = field(default_factory=list)
    asks: Levels = field(default_factory=list)
    checksum: int | None = None
    error: str | None = None


class Fold:
    """State of one feed. `state` and `restore` let a stream carry it between batches."""

    def __init__(self, options: Options):
        self.o = options
        self.sum = CHECKSUMS[options.checksum] if options.checksum else None
        kind = NotedBook if options.policy == "as_of" and not options.max_depth else Book
        self.book, self.truth, self.truth_seq = kind(), kind(), 0
        self.last = self.gen = self.resyncs_in_a_row = self.fault_id = self.fetches = self.attempts = self.transient = 0
        self.bound, self.waiting, self.open_fault = False, False, None
        self.ended: tuple[str, str, int] | None = None
        self.counters = dict.fromkeys(COUNTER_NAMES, 0)
        self.last_event_ms = -1
        self.applied = 0
        self.queue: deque[Row] | Waiting = deque()
        self.views: list[tuple] = []
        self.faults: list[list] = []
        self.kept = True
        self.head = (0, 0)

    # --- outputs

    def now(self, row: Row) -> int:
        return row.ms + self.o.fetch_ms * self.fetches

    def publish(self, row: Row) -> None:
        self.gen += 1
        every = self.o.views_every
        self.kept = bool(every) and self.gen % every == 0
        if self.kept:
            self.views.append((self.gen, row.arrival, self.last, *self.book.top(self.o.depth)))
        self.shown = (self.gen, row.arrival, self.last)

    def fault(self, row: Row, kind: str, reason: str, expected: int = 0, got: int = 0, duration: int = 0) -> list:
        self.fault_id += 1
        f = [self.fault_id, kind, self.now(row), expected, got, reason, duration, row.arrival]
        self.faults.append(f)
        return f

    def end(self, row: Row, state: str, reason: str) -> None:
        self.ended = (state, reason, row.arrival)

    # --- binding

    def try_bind(self, row: Row, snap: Row) -> bool:
        """Takes one snapshot; False if it is refused. The true book's checksum is its own."""
        true = snap.kind == "true-book"
        if self.truth.crossed() if true else raw_crossed(snap.bids, snap.asks):
            self.counters["snapshot_rejects"] += 1
            self.fault(row, "snapshot-reject", "snapshot crossed", got=snap.last_seq)
            self.refusal = "snapshot crossed"
            return False
        if not true:
            self.book = type(self.book)(snap.bids, snap.asks)
            self.book.truncate(self.o.max_depth)
        elif isinstance(self.book, NotedBook):
            self.book.follow(self.truth)
        else:
            self.book = Book(*self.truth.top(self.o.max_depth))
        self.last = snap.last_seq
        if self.sum and not true and self.sum(*self.book.top(10)) != snap.checksum:
            self.counters["checksum_mismatches"] += 1
            self.counters["snapshot_rejects"] += 1
            self.fault(row, "snapshot-reject", "snapshot checksum mismatch", got=snap.last_seq)
            self.refusal = "snapshot checksum mismatch"
            return False
        self.bound, self.waiting, self.attempts = True, False, 0
        self.publish(row)
        if self.open_fault is not None:
            self.open_fault[6] = max(0, self.now(row) - self.open_fault[2])
            self.open_fault = None
        return True

    def fetch(self) -> Row | None:
        self.fetches += 1
        if self.o.policy == "as_of":
            return Row("true-book", last_seq=self.truth_seq)
        return self.queue.popleft() if self.queue else None

    def bind(self, row: Row) -> None:
        """Fetches snapshots until one is taken, within the limits."""
        self.bound, tries, transient = False, 0, 0
        while tries < self.o.bind_attempts:
            snap = self.fetch()
            if snap is None:
                self.fetches -= 1
                return self.end(row, "no_snapshot", "no snapshot is left")
            if snap.error is not None:
                passing = snap.error == "transient"
                self.counters["snapshot_errors"] += 1
                self.fault(row, "snapshot-error", "transient snapshot failure" if passing else "snapshot failed")
                transient += 1
                if not passing or transient > self.o.transient_retries:
                    return self.end(row, "snapshot_failed", "transient snapshot failure" if passing else "snapshot failed")
                continue
            transient = 0
            tries += 1
            if self.try_bind(row, snap):
                return None
        return self.end(row, "snapshot_refused", self.refusal)

    def resync(self, row: Row, f: list) -> None:
        self.counters["resyncs"] += 1
        self.resyncs_in_a_row += 1
        f[6], self.open_fault = -1, f
        self.bound = False
        if self.resyncs_in_a_row > self.o.resync_limit:
            return self.end(row, "stale_snapshot", "resyncs without an applied update")
        if self.o.policy == "in_log":
            self.waiting, self.attempts = True, 0
            return None
        return self.bind(row)

    # --- events

    def start(self, row: Row) -> None:
        self.head = (row.arrival, row.ms)
        if self.o.policy == "in_log":
            self.waiting = True
        else:
            self.bind(row)

    def step(self, row: Row) -> None:
        if self.ended:
            return
        if row.kind == "truth":
            self.truth.apply(row.bids, row.asks)
            self.truth_seq = row.last_seq
            return
        self.last_event_ms = max(self.last_event_ms, row.ms)
        if row.kind == "disconnect":
            self.counters["disconnects"] += 1
            self.resync(row, self.fault(row, "disconnect", "source disconnected"))
        elif row.kind == "snapshot":
            if not self.waiting:  # nobody asked: the connection was lost
                self.counters["disconnects"] += 1
                self.resync(row, self.fault(row, "disconnect", "source disconnected"))
            if not self.ended:
                if row.error is not None:
                    self.end(row, "snapshot_failed", "snapshot failed")
                elif not self.try_bind(row, row):
                    self.attempts += 1
                    if self.attempts >= self.o.bind_attempts:
                        self.end(row, "snapshot_refused", self.refusal)
        elif row.kind == "delta" and not self.waiting:
            self.delta(row)

    def delta(self, row: Row) -> None:
        if row.last_seq <= self.last:
            return
        if row.first_seq > self.last + 1:
            self.counters["gaps"] += 1
            return self.resync(row, self.fault(row, "gap", "sequence gap", self.last + 1, row.first_seq))
        self.book.apply(row.bids, row.asks)
        self.book.truncate(self.o.max_depth)
        self.last = row.last_seq
        if self.book.crossed():
            self.counters["would_crosses"] += 1
            return self.resync(row, self.fault(row, "cross", "delta would cross the book", 0, row.last_seq))
        if self.sum and self.sum(*self.book.top(10)) != row.checksum:
            self.counters["checksum_mismatches"] += 1
            return self.resync(row, self.fault(row, "checksum", "delta checksum mismatch", 0, row.last_seq))
        self.applied += 1
        self.resyncs_in_a_row = 0
        return self.publish(row)

    def status(self) -> tuple[str, str | None, int | None]:
        return self.ended or ("ok" if self.bound else "waiting", None, None)

    def last_view(self) -> list[tuple]:
        """The book at the end, if its view was not kept already."""
        return [(*self.shown, *self.book.top(self.o.depth))] if self.gen and not self.kept and self.bound else []

    def closing(self) -> tuple:
        """The values of the row that ends a fold's output, in the order of `output`."""
        state, reason, at = self.status()
        ended = [self.counters[c] for c in COUNTER_NAMES] + [self.applied, int(self.open_fault is not None), int(self.gen > 0), self.last_event_ms, *self.head]
        return ("end", self.gen, at, self.last, None, None, state, None, None, None, reason, None, ended)

    def enter(self, row: Row) -> bool:
        """Takes up the state that a row holds; whether the feed has started with it."""
        raise NotImplementedError

    def state(self) -> dict:
        """The fold's numbers as plain values for a state store, without books and snapshots."""
        names = ("last", "gen", "resyncs_in_a_row", "fault_id", "fetches", "attempts", "bound", "waiting", "open_fault", "ended", "counters", "last_event_ms", "applied", "truth_seq", "head", "kept")
        return {k: getattr(self, k) for k in names} | {"shown": getattr(self, "shown", None)}

    def restore(self, state: dict) -> None:
        for k, v in state.items():
            setattr(self, k, tuple(v) if k in ("ended", "shown") and v else v)


# --- Arrow in and out ------------------------------------------------------------------------------------------------


def whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def numbers(column: pa.Array) -> list[int]:
    """Whole numbers of a column, null as 0; by way of numpy, which is many times faster than a value at a time."""
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).tolist()


def texts(column: pa.Array) -> list[str | None]:
    """Strings of a column that has few different ones."""
    if column.null_count == len(column):
        return [None] * len(column)
    coded = column.dictionary_encode()
    names = [*coded.dictionary.to_pylist(), None]
    return [names[i] for i in pc.fill_null(coded.indices, len(names) - 1).to_numpy(zero_copy_only=False).tolist()]


def level_lists(column: pa.Array) -> list[Levels]:
    at = column.offsets.to_numpy()
    first, last = (int(at[0]), int(at[-1])) if len(at) else (0, 0)
    own, at = column.values.slice(first, last - first), (at - first).tolist()
    flat = list(zip(numbers(own.field("price")), numbers(own.field("size"))))
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def rows_of(table: pa.Table) -> Iterator[Row]:
    column = lambda c: whole(table.column(c))
    sums = column("checksum")
    checksums = [None] * len(sums) if sums.null_count == len(sums) else sums.to_pylist()
    ms = [ns // 1_000_000 for ns in numbers(column("received_ns"))]
    return map(Row, texts(column("kind")), numbers(column("arrival")), ms, numbers(column("first_seq")), numbers(column("last_seq")), level_lists(column("bids")), level_lists(column("asks")), checksums, texts(column("error")))


class Waiting:
    """Snapshots that wait for a fetch, as Arrow's columns; only those that are fetched next are rows."""

    def __init__(self) -> None:
        self.tables: deque[pa.Table] = deque()
        self.rows: deque[Row] = deque()

    def __bool__(self) -> bool:
        return bool(self.rows or self.tables)

    def add(self, table: pa.Table) -> None:
        self.tables.append(table)

    def popleft(self) -> Row:
        if not self.rows:
            table = self.tables.popleft()
            self.rows.extend(rows_of(table.slice(0, DECODED)))
            if table.num_rows > DECODED:
                self.tables.appendleft(table.slice(DECODED))
        return self.rows.popleft()


def pieces(flags: np.ndarray) -> list[tuple[int, int, bool]]:
    """First and last place of each run of equal flags, and the flag."""
    at = [0, *(np.flatnonzero(flags[1:] != flags[:-1]) + 1).tolist(), len(flags)]
    return [(a, b, bool(flags[a])) for a, b in zip(at[:-1], at[1:])]


def key_runs(table: pa.Table, keys: list[str]) -> list[tuple[int, int, tuple]]:
    """First and last row and key of each run of rows with one key."""
    codes = [pc.fill_null(whole(table.column(c)).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False) for c in keys]
    new = np.any([c[1:] != c[:-1] for c in codes], axis=0)
    starts = [0, *(np.flatnonzero(new) + 1).tolist()]
    return [(a, b, tuple(table.column(c)[a].as_py() for c in keys)) for a, b in zip(starts, [*starts[1:], table.num_rows])]


OUT = f"venue string, symbol string, segment bigint, what string, n bigint, arrival bigint, last_seq bigint, bids {LEVELS}, asks {LEVELS}, kind string, at_ms bigint, expected_seq bigint, got_seq bigint, reason string, duration_ms bigint, counters array<bigint>"
_LEVEL = pa.list_(pa.struct([("price", pa.int64()), ("size", pa.int64())]))


def fold_rows(options: Options, rows: Iterable[Row], queue: list[Row] | None = None) -> Fold:
    fold = Fold(options)
    fold.queue = deque(queue or ())
    started = False
    for row in rows:
        if not started and row.kind != "truth":
            fold.start(row)
            started = True
        fold.step(row)
    return fold


def output(fold: Fold, venue: str, symbol: str, segment: int, closing: bool = True) -> pa.Table:
    """Views, faults and, if closing, one closing row of a fold as a table of OUT's columns."""
    views = fold.views + (fold.last_view() if closing else [])
    out: list[tuple] = [("view", g, a, s, b, k, None, None, None, None, None, None, None) for g, a, s, b, k in views]
    out += [("fault", f[0], f[7], None, None, None, f[1], f[2], f[3], f[4], f[5], f[6], None) for f in fold.faults if closing or f is not fold.open_fault]
    if closing:
        out.append(fold.closing())
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), None, None, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64())]
    names = ["what", "n", "arrival", "last_seq", "bids", "asks", "kind", "at_ms", "expected_seq", "got_seq", "reason", "duration_ms", "counters"]
    cols = list(zip(*out))
    arrays: dict[str, pa.Array] = {"venue": pa.array([venue] * len(out), pa.string()), "symbol": pa.array([symbol] * len(out), pa.string()), "segment": pa.array([segment] * len(out), pa.int64())}
    for name, t, values in zip(names, types, cols):
        if t is None:
            size = [len(v) if v is not None else 0 for v in values]
            flat = [x for v in values if v for x in v]
            levels = pa.StructArray.from_arrays([pa.array([p for p, _ in flat], pa.int64()), pa.array([s for _, s in flat], pa.int64())], names=["price", "size"])
            at_ = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            arrays[name] = pa.ListArray.from_arrays(pa.array(at_, mask=np.array([v is None for v in values] + [False])), levels) if len(out) else pa.array([], _LEVEL)
        else:
            arrays[name] = pa.array(values, t)
    return pa.table(arrays)


def log_rows(events: DataFrame, snapshots: DataFrame | None) -> DataFrame:
    """Events and snapshots of all feeds in one layout for the fold; `queued` marks snapshots that wait for a fetch."""
    cols = ["venue", "symbol", "arrival", "received_ns", "kind", "first_seq", "last_seq", "bids", "asks", "checksum"]
    rows = events.select(*cols, (F.col("error") if "error" in events.columns else F.lit(None).cast("string")).alias("error"), F.lit(False).alias("queued"), (F.col("sub") if "sub" in events.columns else F.lit(0)).cast("bigint").alias("sub"))
    if snapshots is None:
        return rows
    # the queue comes first, whatever its arrival, which is not null, so that all arrivals stay whole numbers
    queue = snapshots.select("venue", "symbol", F.lit(0).cast("bigint").alias("arrival"), F.lit(0).cast("bigint").alias("received_ns"), F.lit("snapshot").alias("kind"), F.col("last_update_id").alias("first_seq"), F.col("last_update_id").alias("last_seq"), "bids", "asks", "checksum", "error", F.lit(True).alias("queued"), F.col("snap_ord").alias("sub"))
    return rows.unionByName(queue)


def fold_sorted(rows: DataFrame, options: Options, fold_type: type[Fold] = Fold, tasks: int | None = None) -> DataFrame:
    """The folds of all (venue, symbol, segment) of rows, which are dealt by it.

    A task reads its rows in order, batch by batch, and hands on what is settled after every VIEWS_A_BATCH views and
    every batch: it holds books, a batch, the snapshots that wait for a fetch (in Arrow's columns, 16 bytes a level), and
    the open fault. tasks: how many, where
    the folds to be done are known, as Spark joins small tasks by their bytes, not by what a fold takes.
    """
    keys = [*KEY, "segment"]
    last = lambda c: F.col(c).asc_nulls_last()
    if "max_depth" not in rows.columns:
        rows = rows.withColumn("max_depth", F.lit(None).cast("int"))
    dealt = (rows.repartition(tasks, *keys) if tasks else rows.repartition(*keys)).sortWithinPartitions(*keys, F.desc("queued"), last("arrival"), last("sub"))

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, at, started = None, None, False

        def settled() -> Iterator[pa.RecordBatch]:
            if fold.views or any(f is not fold.open_fault for f in fold.faults):
                yield from output(fold, *at, closing=False).to_batches()
                fold.views, fold.faults = [], [f for f in fold.faults if f is fold.open_fault]

        for batch in batches:
            table = pa.Table.from_batches([batch])
            queued = table.column("queued").to_numpy()
            waits = queued & pc.equal(table.column("kind"), "snapshot").fill_null(False).to_numpy()
            rows = rows_of(table.filter(pa.array(~waits)) if waits.any() else table)
            for first, end, key in key_runs(table, keys) if table.num_rows else []:
                if fold is None or key != at:
                    if fold is not None:
                        yield from output(fold, *at).to_batches()
                    window = table.column("max_depth")[first].as_py()
                    fold = fold_type(options if window is None else replace(options, max_depth=window))
                    fold.queue = Waiting()
                    at, started = key, False
                for a, b, wait in pieces(waits[first:end]):
                    if wait:
                        fold.queue.add(table.slice(first + a, b - a))
                        continue
                    for given, row in zip(queued[first + a : first + b].tolist(), rows):
                        if given:
                            started = fold.enter(row) or started
                            continue
                        if not started and row.kind != "truth":
                            fold.start(row)
                            started = True
                        fold.step(row)
                        if len(fold.views) >= VIEWS_A_BATCH:
                            yield from settled()
            if fold is not None:
                yield from settled()
        if fold is not None:
            yield from output(fold, *at).to_batches()

    return dealt.mapInArrow(folded, OUT)


def replay(events: DataFrame, snapshots: DataFrame | None = None, options: Options = Options(), instruments: DataFrame | None = None) -> DataFrame:
    """The fold over all feeds: one table of views, faults and closing rows (see views, faults, counters, status).

    events: FEED_EVENTS (kinds delta, trade, disconnect, and for in_log snapshot, for as_of truth), ordered by arrival
    within a feed, ties by an optional `sub`. snapshots: SNAPSHOTS in fetch order by snap_ord, for the policy `queue`.
    instruments (KEY, max_depth): windows of feeds, where they differ from the options'; a feed without a row has those.
    Keep or write the result before taking its parts, or the fold runs once for each.
    """
    rows = log_rows(events, snapshots if options.policy == "queue" else None)
    if instruments is not None:
        rows = rows.join(instruments.select(*KEY, F.col("max_depth").cast("int").alias("max_depth")), KEY, "left")
    return fold_sorted(rows.withColumn("segment", F.lit(0).cast("bigint")), options)


def replay_segments(events: DataFrame, options: Options) -> DataFrame:
    """The replay of feeds whose snapshots are in their log, a segment at a time, with the same result as replay().

    Segments begin at snapshot rows and are folded side by side; generations, fault ids and counters are running sums
    over them. A segment that follows one without an open fault starts by a disconnect. A feed ends where bind_attempts
    snapshots in a row were refused, or more than resync_limit resyncs passed without an applied update.
    """
    snapshot = (F.col("kind") == "snapshot").cast("bigint")
    rows = running(log_rows(events, None), KEY, "arrival", {"segment": (SUM, snapshot)}, then=("sub",)).where("segment > 0")
    # read by several steps, folded once
    parts = written(fold_sorted(rows, options), "segments")
    return stitch(parts, options)


def _took(ms):
    """A duration that is never negative; -1 if it is not known."""
    return F.when(ms.isNull(), F.lit(-1)).otherwise(F.greatest(F.lit(0), ms)).cast("bigint")


def stitch(parts: DataFrame, options: Options) -> DataFrame:
    """One replay out of its segments' replays; their closing rows say where each began."""
    feed = Window.partitionBy(*KEY).orderBy("segment")
    before = feed.rowsBetween(Window.unboundedPreceding, -1)
    faults = parts.where("what = 'fault'").groupBy(*KEY, "segment").agg(F.count("*").alias("n_faults"))
    n = len(COUNTER_NAMES)
    ends = parts.where("what = 'end'").select(*KEY, "segment", F.col("n").alias("gens"), "counters", F.col("counters")[n + 4].alias("head"), F.col("counters")[n + 5].alias("head_ms"))
    ends = ends.join(faults, [*KEY, "segment"], "left").fillna(0, ["n_faults"])
    at = {c: F.col("counters")[i] for i, c in enumerate(COUNTER_NAMES)}
    ends = ends.withColumns({"bound": F.col("gens") > 0, "broken": F.col("counters")[n + 1] > 0, "did": F.col("counters")[n] > 0})
    # a disconnect opens a segment unless the feed was waiting: first segment, a fault before it, a refused snapshot before it
    ends = ends.withColumn("lost", (F.lag("bound").over(feed) & ~F.lag("broken").over(feed)).cast("bigint")).fillna(0, ["lost"])
    # refusals in a row, and resyncs in a row without an applied update
    ends = ends.withColumn("_runs", F.count_if("bound").over(feed)).withColumn("_work", F.coalesce(F.count_if("did").over(before), F.lit(0)))
    run = Window.partitionBy(*KEY, "_runs").orderBy("segment")
    idle = Window.partitionBy(*KEY, "_work").orderBy("segment")
    resyncs = F.col("lost") + at["resyncs"]
    ends = ends.withColumn("_refused", F.count_if(~F.col("bound")).over(run)).withColumn("_idle", F.sum(F.when(F.col("did"), F.col("lost")).otherwise(resyncs)).over(idle))
    ended = F.when(F.col("_idle") > options.resync_limit, "stale_snapshot").when(F.col("_refused") >= options.bind_attempts, "snapshot_refused")
    ends = ends.withColumn("_ended", ended)
    first = F.min(F.when(F.col("_ended").isNotNull(), F.col("segment"))).over(Window.partitionBy(*KEY))
    ends = ends.withColumn("_stop", first).where(F.col("_stop").isNull() | (F.col("segment") <= F.col("_stop")))
    ends = ends.withColumns({"gen0": F.coalesce(F.sum("gens").over(before), F.lit(0)), "id0": F.coalesce(F.sum(F.col("n_faults") + F.col("lost")).over(before), F.lit(0))})
    # backwards, as Spark goes through the whole rest of a feed for each row of a window that ends with it
    ahead = Window.partitionBy(*KEY).orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("next_bind_ms", F.last(F.when(F.col("bound"), F.col("head_ms")), ignorenulls=True).over(ahead))
    offsets = ends.select(*KEY, "segment", "gen0", "id0", "lost", "next_bind_ms", "head", "head_ms", "bound")
    inner = parts.where("what != 'end'").join(offsets, [*KEY, "segment"])
    view = F.col("what") == "view"
    moved = inner.withColumns(
        {
            "n": F.when(view, F.col("n") + F.col("gen0")).otherwise(F.col("n") + F.col("id0") + F.col("lost")),
            "duration_ms": F.when(F.col("duration_ms") == -1, _took(F.col("next_bind_ms") - F.col("at_ms"))).otherwise(F.col("duration_ms")),
        }
    ).select(*parts.columns)
    nothing = F.lit(None).cast(LEVELS)
    took = F.when(F.col("bound"), F.lit(0)).otherwise(_took(F.col("next_bind_ms") - F.col("head_ms")))
    none = F.lit(None).cast("bigint")
    lost = offsets.where("lost = 1").select(*KEY, "segment", F.lit("fault").alias("what"), (F.col("id0") + 1).alias("n"), F.col("head").alias("arrival"), none.alias("last_seq"), nothing.alias("bids"), nothing.alias("asks"), F.lit("disconnect").alias("kind"), F.col("head_ms").alias("at_ms"), F.lit(0).cast("bigint").alias("expected_seq"), F.lit(0).cast("bigint").alias("got_seq"), F.lit("source disconnected").alias("reason"), took.cast("bigint").alias("duration_ms"), F.lit(None).cast("array<bigint>").alias("counters"))
    sums = [F.sum(at[c] + (F.col("lost") if c in ("resyncs", "disconnects") else F.lit(0))).alias(c) for c in COUNTER_NAMES]
    last = F.max_by(F.struct("bound", "broken", "_ended", "head"), "segment").alias("z")
    closing = ends.groupBy(*KEY).agg(*sums, F.sum("gens").alias("n"), F.sum(F.col("counters")[n]).alias("applied"), F.max(F.col("counters")[n + 3]).alias("ms"), last)
    state = F.coalesce(F.col("z._ended"), F.when(F.col("z.bound") & ~F.col("z.broken"), "ok").otherwise("waiting"))
    closing = closing.select(*KEY, F.lit(0).cast("bigint").alias("segment"), F.lit("end").alias("what"), "n", F.when(F.col("z._ended").isNotNull(), F.col("z.head")).alias("arrival"), none.alias("last_seq"), nothing.alias("bids"), nothing.alias("asks"), state.alias("kind"), none.alias("at_ms"), none.alias("expected_seq"), none.alias("got_seq"), F.lit(None).cast("string").alias("reason"), none.alias("duration_ms"), F.array(*COUNTER_NAMES, "applied", F.col("z.broken").cast("bigint"), (F.col("n") > 0).cast("bigint"), "ms").alias("counters"))
    return moved.unionByName(lost).unionByName(closing)


def views(out: DataFrame) -> DataFrame:
    return out.where("what = 'view'").select(*KEY, F.col("n").alias("gen"), "arrival", "last_seq", "bids", "asks")


def faults(out: DataFrame) -> DataFrame:
    return out.where("what = 'fault'").select(*KEY, F.col("n").alias("id"), "kind", "at_ms", "expected_seq", "got_seq", "reason", "duration_ms", "arrival")


def counters(out: DataFrame) -> DataFrame:
    """Counters of each feed, with applied updates, generations and the time of the last processed event."""
    cols = [F.col("counters")[i].alias(c) for i, c in enumerate(COUNTER_NAMES)]
    n = len(COUNTER_NAMES)
    return out.where("what = 'end'").select(*KEY, *cols, F.col("counters")[n].alias("applied"), F.col("n").alias("gens"), F.col("counters")[n + 3].alias("last_event_ms"))


def status(out: DataFrame) -> DataFrame:
    return out.where("what = 'end'").select(*KEY, F.col("kind").alias("state"), "reason", F.col("arrival").alias("at_arrival"))


# --- on the replay's tables: windows and aggregates -------------------------------------------------------------------


def following(rows: DataFrame, by: str, then: str, name: str, value: Column) -> DataFrame:
    """rows with `name`: the next value that is not null, in the order of `by` (null first) and `then`, of rows that have
    none themselves. Taken backwards and by stretches of a feed, so that its cost grows with the rows."""
    back = {"_back": F.coalesce(-F.col(by), F.lit(2**62)), "_then": -F.col(then)}
    return running(rows.withColumns(back), KEY, "_back", {name: (LAST, value)}, then=("_then",)).drop(*back)


def bind_points(snapshots: DataFrame, deltas: DataFrame) -> DataFrame:
    """For each snapshot the first delta above it, and whether it covers the next id (else the snapshot is too old).

    A union and a running figure instead of a range join: snapshots and deltas of a feed, the highest ids first.
    """
    s = snapshots.select(*KEY, F.col("last_update_id").alias("id"), F.lit(1).alias("_o"), F.lit(None).cast("bigint").alias("first_seq"), F.lit(None).cast("bigint").alias("arrival"), "snap_ord")
    d = deltas.select(*KEY, F.col("last_seq").alias("id"), F.lit(0).alias("_o"), "first_seq", "arrival", F.lit(None).cast("bigint").alias("snap_ord"))
    # deltas with an id equal to the snapshot's are stale and sort before it
    next_ = F.when(F.col("_o") == 0, F.struct("arrival", "first_seq", "id"))
    out = following(s.unionByName(d), "id", "_o", "d", next_).where("_o = 1")
    return out.select(*KEY, "snap_ord", F.col("id").alias("last_update_id"), F.col("d.arrival").alias("bind_arrival"), F.when(F.col("d").isNotNull(), F.col("d.first_seq") <= F.col("id") + 1).alias("covers"))


def recovery(fault_rows: DataFrame, binds: DataFrame) -> DataFrame:
    """duration_ms of each fault from the next bind (KEY, arrival, at_ms) of its feed: -1 if there is none, never negative."""
    f = fault_rows.select(*KEY, "arrival", "at_ms", F.col("id"), F.lit(0).alias("_b"))
    b = binds.select(*KEY, "arrival", "at_ms", F.lit(None).cast("bigint").alias("id"), F.lit(1).alias("_b"))
    out = following(f.unionByName(b), "arrival", "_b", "_n", F.when(F.col("_b") == 1, F.col("at_ms"))).where("_b = 0")
    return out.select(*KEY, "id", _took(F.col("_n") - F.col("at_ms")).alias("duration_ms"))


def newest_faults(fault_rows: DataFrame, n: int = 16) -> DataFrame:
    return fault_rows.withColumn("_r", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("id")))).where(F.col("_r") <= n).drop("_r")


def count_faults(fault_rows: DataFrame, rejects: DataFrame | None = None) -> DataFrame:
    """Counters of each feed from its fault log, and rejected frames from `rejects`."""
    kind, reason = F.col("kind"), F.col("reason")
    out = fault_rows.groupBy(*KEY).agg(
        F.count_if(kind == "gap").alias("gaps"),
        F.count_if(kind.isin("gap", "cross", "checksum", "disconnect")).alias("resyncs"),
        F.count_if(kind == "disconnect").alias("disconnects"),
        F.count_if(kind == "cross").alias("would_crosses"),
        F.count_if((kind == "checksum") | (reason == "snapshot checksum mismatch")).alias("checksum_mismatches"),
        F.count_if(kind == "snapshot-reject").alias("snapshot_rejects"),
        F.count_if(kind == "snapshot-error").alias("snapshot_errors"),
    )
    if rejects is not None:
        out = out.join(rejects.groupBy(*KEY).agg(F.count("*").alias("rejected")), KEY, "full_outer")
        return out.fillna(0, list(COUNTER_NAMES))
    return out.withColumn("rejected", F.lit(0).cast("bigint"))


def counters_by_venue(counter_rows: DataFrame) -> DataFrame:
    """Roll-up of counters by venue and over all feeds."""
    return counter_rows.rollup("venue").agg(*[F.sum(c).alias(c) for c in COUNTER_NAMES])


def generations(published: DataFrame) -> DataFrame:
    """gen of published rows: one up for each, never reset."""
    return running(published, KEY, "arrival", {"gen": (SUM, F.lit(1).cast("bigint"))})


def downtime(fault_rows: DataFrame) -> DataFrame:
    """Intervals a feed was not ready, from a rebuild's fault to its end, and their sum; an open one has no end."""
    rebuild = fault_rows.where(F.col("kind").isin("gap", "cross", "checksum", "disconnect"))
    out = rebuild.select(*KEY, "id", F.col("at_ms").alias("from_ms"), F.when(F.col("duration_ms") >= 0, F.col("at_ms") + F.col("duration_ms")).alias("to_ms"))
    return out.withColumn("down_ms", F.sum(F.col("to_ms") - F.col("from_ms")).over(Window.partitionBy(*KEY)))


def last_event_age(events: DataFrame, now_ms: int) -> DataFrame:
    """Age of the newest processed event of each feed at an instant: -1 before the first, never negative."""
    newest = events.groupBy(*KEY).agg(F.max(F.expr("received_ns div 1000000")).alias("last_event_ms"))
    return newest.withColumn("age_ms", F.when(F.col("last_event_ms").isNull() | (F.col("last_event_ms") <= 0), F.lit(-1)).otherwise(F.greatest(F.lit(0), F.lit(now_ms) - F.col("last_event_ms"))).cast("bigint"))


def best_series(view_rows: DataFrame, fault_rows: DataFrame) -> DataFrame:
    """Best bid and ask of two-sided views in order, with the kind of fault at the same arrival and a crossed flag."""
    best = view_rows.where((F.size("bids") > 0) & (F.size("asks") > 0)).select(*KEY, "gen", "arrival", F.col("bids")[0]["price"].alias("bid"), F.col("asks")[0]["price"].alias("ask"))
    marks = fault_rows.where(F.col("kind").isin("gap", "cross")).groupBy(*KEY, "arrival").agg(F.min("kind").alias("fault"))
    return best.join(marks, [*KEY, "arrival"], "left").withColumn("is_crossed", F.col("bid") >= F.col("ask"))


def count_crossed(series: DataFrame) -> DataFrame:
    """The series with `crossed`, the number of crossed states in all of its feed."""
    n = series.groupBy(*KEY).agg(F.count_if("is_crossed").alias("crossed"))
    return series.join(n, KEY)
