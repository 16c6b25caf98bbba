"""Schemas of the canonical tables. Prices and sizes are integers at the scales of `instruments`, never floating point."""

from __future__ import annotations

LEVELS = "array<struct<price:bigint,size:bigint>>"
FEED = "venue string, symbol string"
INSTRUMENTS = f"{FEED}, price_scale int, size_scale int, max_depth int, has_checksum boolean"
RAW_FRAMES = f"{FEED}, arrival bigint, received_ns bigint, raw string"
FEED_EVENTS = f"{FEED}, arrival bigint, received_ns bigint, kind string, first_seq bigint, last_seq bigint, bids {LEVELS}, asks {LEVELS}, checksum bigint"
SNAPSHOTS = f"{FEED}, snap_ord bigint, arrival bigint, last_update_id bigint, bids {LEVELS}, asks {LEVELS}, checksum bigint, error string"
VIEWS = f"{FEED}, gen bigint, arrival bigint, last_seq bigint, bids {LEVELS}, asks {LEVELS}"
FAULTS = f"{FEED}, id bigint, kind string, at_ms bigint, expected_seq bigint, got_seq bigint, reason string, duration_ms bigint, arrival bigint"
COUNTER_NAMES = ("gaps", "resyncs", "disconnects", "would_crosses", "checksum_mismatches", "snapshot_rejects", "snapshot_errors", "rejected")
COUNTERS = f"{FEED}, " + ", ".join(f"{c} bigint" for c in COUNTER_NAMES)
FEED_STATUS = f"{FEED}, state string, reason string, at_arrival bigint"
KEY = ["venue", "symbol"]
