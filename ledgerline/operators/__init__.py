"""Jobs on feed tables: ordering, books, replay, fault injection, figures, telemetry, fan-out and latency."""
