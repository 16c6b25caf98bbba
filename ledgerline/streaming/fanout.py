"""Latest-wins delivery as a stream: a slot for each consumer, which publishes fill and takes empty."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.fanout import CONSUMER
from ..schema import FEED
from .packs import PACK, given, handed, packed, unpacked

OUTCOMES = "venue string, symbol string, consumer {}, arrival bigint, op string, outcome string, got_seq bigint, disconnected boolean"


class DeliveryProcessor(StatefulProcessor):
    """The view in a consumer's slot, how often in a row one was superseded, and whether the consumer was cut off."""

    def __init__(self, max_lag: int | None):
        self.max_lag = None if max_lag is None else max(max_lag, 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.saved = handle.getValueState("slot", "full boolean, view_seq bigint, streak bigint, cut boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        slot = self.saved.get() if self.saved.exists() else (False, None, 0, False)
        if not slot[3]:
            out, slot = delivered(given(rows), slot, self.max_lag)
            self.saved.update(slot)
            yield from handed(out, dict(zip(CONSUMER, key)))

    def close(self) -> None:
        pass


def before(flags: np.ndarray) -> np.ndarray:
    """For each place the last one before it with a flag, -1 if there is none."""
    places = np.maximum.accumulate(np.where(flags, np.arange(len(flags)), -1))
    return np.concatenate([[-1], places[:-1]])


def delivered(log: pa.Table, slot: tuple, max_lag: int | None) -> tuple[pa.Table, tuple]:
    """Outcomes of a consumer's rows (arrival, op, view_seq) in order, from its slot on, and the slot after them."""
    full, newest, streak, _ = slot
    log = log.sort_by([("arrival", "ascending"), ("op", "ascending")])
    take = pc.equal(log.column("op"), "take").to_numpy(zero_copy_only=False)
    publish, known = ~take, pc.is_valid(log.column("view_seq")).to_numpy(zero_copy_only=False)
    seqs = pc.fill_null(log.column("view_seq"), 0).to_numpy()
    taken, sent, n = before(take), np.cumsum(publish), np.arange(len(take))
    # publishes since the last take up to a row; those before the batch count where no take came yet
    earlier = (streak + 1) * full
    since = sent - np.where(taken >= 0, sent[taken], 0) + np.where(taken >= 0, 0, earlier)
    shown = before(publish & known)
    view = shown > taken  # a view is in the slot that came in this batch
    old = (taken < 0) & ~view & (newest is not None)
    cut = np.flatnonzero(publish & (since - 1 >= max_lag))[:1] if max_lag is not None else n[:0]
    end = int(cut[0]) + 1 if len(cut) else len(take)
    got = np.where(view, seqs[shown], newest or 0)
    has = take & (view | old)
    outcome = np.where(publish, np.where(since > 1, "supersedes", "delivered"), np.where(has, "taken", "nothing"))
    out = pa.table({"arrival": log.column("arrival"), "op": log.column("op"), "outcome": pa.array(outcome, pa.string()), "got_seq": pa.array(got, pa.int64(), mask=~has), "disconnected": pa.array(n == end - 1) if len(cut) else pa.array(n < 0)}).slice(0, end)
    # the slot after the last row, as the next row would find it
    last = int(np.flatnonzero(take)[-1]) if take.any() else -1
    seen = np.flatnonzero(publish & known)
    left = int(since[-1]) if not take[-1] else 0
    held = int(seqs[seen[-1]]) if len(seen) and seen[-1] > last else newest if last < 0 else None
    return out, (left > 0, held, max(left - 1, 0), len(cut) > 0)


def delivery_stream(log: DataFrame, max_lag: int | None = None) -> DataFrame:
    """Outcomes of publishes and takes of consumers, as operators.fanout.conflate, from a stream of their log (CONSUMER,
    arrival, op, view_seq; see consumer_log, which joins a stream of publishes to a table of subscriptions).

    Arrivals of a consumer must not fall from one micro-batch to the next. With max_lag, the supersede that is the
    max_lag-th in a row cuts the consumer off (`disconnected`); nothing comes after it.
    """
    kind = log.schema["consumer"].dataType.simpleString()
    rows = packed(log.select(*CONSUMER, "arrival", "op", "view_seq"), CONSUMER)
    out = rows.groupBy(*CONSUMER).transformWithState(DeliveryProcessor(max_lag), outputStructType=StructType.fromDDL(f"{FEED}, consumer {kind}, {PACK}"), outputMode="Append", timeMode="None")
    return unpacked(out, CONSUMER, OUTCOMES.format(kind))
