"""Telemetry of feeds over time: merging fault events of frames, restarts, health of polls and links, status documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import COUNTER_NAMES, KEY
from .scans import LAST, MOST, SUM, running

RING = 16
FAILURES_BEFORE_UNAVAILABLE = 3
NO_DATA_MS, QUIET_MS = 3000, 10_000
MAX_COUNTDOWN_S = 30
#: Ticks that are made, and rows of a span of which are summed, at a time.
TICKS = 3600
EVENTS = "array<struct<id:bigint,kind:string,at_ms:bigint,expected_seq:bigint,got_seq:bigint,reason:string,duration_ms:bigint>>"


def _w():
    return Window.partitionBy(*KEY).orderBy("ord")


def _upto():
    """The rows of the feed up to this one."""
    return _w().rowsBetween(Window.unboundedPreceding, 0)


def newest_id(events: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(events, lambda e: e["id"])), F.lit(0))


def runs(frames: DataFrame) -> DataFrame:
    """run of each telemetry frame (KEY, ord, counters, events): a new one where the server started again.

    That shows by the newest event id going back below any known in the frame before, or by a fallen counter.
    """
    fell = F.lit(False)
    for c in COUNTER_NAMES:
        fell = fell | F.coalesce(F.col(c) < F.lag(c).over(_w()), F.lit(False))
    rows = frames.withColumn("_id", newest_id(F.col("events")))
    restarted = fell | F.coalesce(F.col("_id") < F.lag("_id").over(_w()), F.lit(False))
    return rows.withColumn("restarted", restarted).withColumn("run", F.sum(F.col("restarted").cast("bigint")).over(_upto())).drop("_id")


def merge_events(run_frames: DataFrame) -> DataFrame:
    """The newest 16 events of each run by their latest copy, newest first by `rank`; input: runs(). Reduced map-side."""
    e = run_frames.select(*KEY, "run", "ord", F.explode("events").alias("e"))
    latest = e.groupBy(*KEY, "run", F.col("e.id").alias("id")).agg(F.max_by("e", "ord").alias("e"))
    ranked = latest.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY, "run").orderBy(F.desc("id"))))
    return ranked.where(F.col("rank") <= RING).select(*KEY, "run", "rank", "e.*")


def lost_events(run_frames: DataFrame) -> DataFrame:
    """Events that happened between frames and were in none, by run: ids jumped over."""
    ids = run_frames.select(*KEY, "run", "ord", F.array_min(F.transform("events", lambda e: e["id"])).alias("lo"), newest_id(F.col("events")).alias("hi")).where("lo is not null")
    known = F.max("hi").over(Window.partitionBy(*KEY, "run").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    return ids.withColumn("_k", known).groupBy(*KEY, "run").agg(F.sum(F.coalesce(F.greatest(F.lit(0), F.col("lo") - F.col("_k") - 1), F.lit(0))).alias("lost"))


def new_entries(run_frames: DataFrame) -> DataFrame:
    """Events recorded since the first frame of each run."""
    ids = run_frames.groupBy(*KEY, "run").agg(F.max(newest_id(F.col("events"))).alias("newest"), F.min_by(newest_id(F.col("events")), "ord").alias("baseline"))
    return ids.withColumn("new_entries", F.greatest(F.lit(0), F.col("newest") - F.col("baseline")))


def fault_summary(counters: DataFrame, events: DataFrame) -> DataFrame:
    """repaired, in_progress and the newest rebuild event of each feed, from its resyncs and its kept events."""
    rebuild = events.where(F.col("kind").isin(*S.REBUILD_KINDS)).groupBy(*KEY).agg(F.max_by(F.struct("id", "kind", "duration_ms"), "id").alias("latest"))
    out = counters.select(*KEY, "resyncs").join(rebuild, KEY, "left")
    running = F.coalesce(F.col("latest.duration_ms") == -1, F.lit(False))
    return out.select(*KEY, F.greatest(F.lit(0), F.col("resyncs") - running.cast("int")).alias("repaired"), running.alias("in_progress"), F.col("latest.id").alias("latest_id"), F.col("latest.kind").alias("latest_kind"))


def describe_faults(events: DataFrame) -> DataFrame:
    """Title, detail and rebuild wording of every event of a feed's fault log."""
    newest = F.max(F.when(F.col("kind").isin(*S.REBUILD_KINDS), F.col("id"))).over(Window.partitionBy(*KEY))
    rows = events.withColumn("_n", newest)
    rows = rows.withColumn("rebuild", S.fault_rebuild(F.col("kind"), F.col("id"), F.col("duration_ms"), F.col("_n")))
    detail = S.fault_detail(F.col("kind"), F.col("expected_seq"), F.col("got_seq"), F.col("reason"), F.col("rebuild"))
    return rows.withColumns({"title": S.fault_title(F.col("kind")), "detail": detail}).drop("_n")


def view_checks(views: DataFrame) -> DataFrame:
    """Two-sided views tested for a crossing and those refused, of each feed; views hold string levels."""
    both = (F.size("bids") > 0) & (F.size("asks") > 0)
    bad = both & S.crossed(F.col("bids")[0][0], F.col("asks")[0][0])
    return views.withColumns({"_t": both, "_r": F.coalesce(bad, F.lit(False))}).groupBy(*KEY).agg(F.count_if("_t").alias("checked"), F.count_if("_r").alias("refused"))


def poll_health(polls: DataFrame) -> DataFrame:
    """State after each poll (KEY, ord, ok, status): ok, degraded, loading before any success, unavailable after three
    failures in a row; the last good status stays."""
    bad = (~F.col("ok")).cast("bigint")
    rows = running(polls, KEY, "ord", {"last_ok": (MOST, F.when(F.col("ok"), F.col("ord"))), "_bad": (SUM, bad), "shown_status": (LAST, F.when(F.col("ok"), F.col("status")))})
    rows = running(rows, KEY, "ord", {"_then": (LAST, F.when(F.col("ok"), F.col("_bad")))})
    rows = rows.withColumn("failures", F.col("_bad") - F.coalesce("_then", F.lit(0))).drop("_bad", "_then")
    state = F.when(F.col("ok"), "ok").when(F.col("failures") >= FAILURES_BEFORE_UNAVAILABLE, "unavailable").when(F.col("last_ok").isNull(), "loading").otherwise("degraded")
    return rows.withColumn("state", state)


def link_state(events: DataFrame) -> DataFrame:
    """State of a link after each of its events (KEY, ord, type, now_ms, attempt, retry_at).

    Types: connecting, open, transient, closed, telemetry, view, invalid. A link event sets the link; open also starts
    the beat and forgets the view; closed carries the attempt and when the next one comes; telemetry beats, view marks
    the view, invalid counts a drop.
    """
    kind = F.col("type")
    turns = kind.isin("connecting", "open", "transient", "closed")
    opened = kind == "open"
    one = lambda cond: (SUM, cond.cast("bigint"))
    last = lambda cond, value: (LAST, F.when(cond, value))
    rows = running(
        events,
        KEY,
        "ord",
        {
            "link": last(turns, kind),
            "_opens": one(opened),
            "tries": last(opened | (kind == "closed"), F.when(opened, F.lit(0)).otherwise(F.col("attempt"))),
            "open_at": last(opened, F.col("now_ms")),
            "beat_at": last(opened | (kind == "telemetry"), F.col("now_ms")),
            "view_at": last(opened | (kind == "view"), F.when(opened, F.lit(0)).otherwise(F.col("now_ms"))),
            "dropped": one(kind == "invalid"),
            "_retry": last(turns, F.when(kind == "closed", F.col("retry_at")).otherwise(F.lit(-1))),
        },
    )
    rows = rows.fillna("connecting", ["link"]).fillna(0, ["tries", "open_at", "beat_at", "view_at"]).withColumn("ever_opened", F.col("_opens") > 0)
    return rows.withColumn("retry_at", F.when(F.col("_retry") >= 0, F.col("_retry"))).drop("_retry", "_opens")


def freshness(samples: DataFrame, states: DataFrame) -> DataFrame:
    """Label of each feed's link at sample instants (KEY, now_ms), from link_state() rows with the time they happened.

    The state at an instant is the last one at or before it: a union with the events and a window, no range join.
    """
    cols = ["link", "ever_opened", "tries", "retry_at", "open_at", "beat_at", "view_at"]
    at = states.select(*KEY, F.col("now_ms").alias("t"), F.lit(0).alias("_s"), "ord", F.struct(*cols).alias("s"))
    asked = samples.select(*KEY, F.col("now_ms").alias("t"), F.lit(1).alias("_s"), F.lit(None).cast("bigint").alias("ord"), F.lit(None).cast(at.schema["s"].dataType).alias("s"))
    order = Window.partitionBy(*KEY).orderBy("t", "_s", "ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = at.unionByName(asked).withColumn("s", F.last("s", ignorenulls=True).over(order)).where("_s = 1 and s is not null").select(*KEY, F.col("t").alias("now_ms"), "s.*")
    beat = F.greatest(F.lit(0), F.col("now_ms") - F.col("beat_at"))
    view = F.greatest(F.lit(0), F.col("now_ms") - F.when(F.col("view_at") > 0, F.col("view_at")).otherwise(F.col("open_at")))
    silent = (F.col("beat_at") > 0) & (beat > NO_DATA_MS)
    label = (
        F.when(F.col("link") == "connecting", F.when(F.col("ever_opened"), "reconnecting").otherwise("connecting"))
        .when(F.col("link") == "transient", "transient")
        .when(F.col("link") == "closed", "reconnecting")
        .when(silent, "no-data")
        .when(view >= QUIET_MS, "quiet")
        .otherwise("live")
    )
    seconds = F.least(F.lit(MAX_COUNTDOWN_S), F.greatest(F.lit(0), F.ceil((F.coalesce("retry_at", "now_ms") - F.col("now_ms")) / 1000)))
    detail = (
        F.when(F.col("link") == "closed", F.concat(F.lit("in "), seconds.cast("string"), F.lit(" s · attempt "), F.col("tries").cast("string")))
        .when((F.col("link") == "open") & silent, F.concat(F.floor(beat / 1000).cast("string"), F.lit(" s")))
        .when((F.col("link") == "open") & (view >= QUIET_MS), "market quiet")
        .when((F.col("link") == "open") & (F.col("view_at") > 0), S.format_age(view))
    )
    return rows.select(*KEY, "now_ms", label.alias("label"), detail.alias("detail"))


def telemetry_frames(faults: DataFrame, views: DataFrame, first_ms: int, last_ms: int, step_ms: int = 1000) -> DataFrame:
    """A frame a feed and second: running counters, the newest view's sequence and the last 16 fault events so far.

    faults: KEY, id, kind, at_ms and the other fault columns; views: KEY, at_ms, gen, last_seq.
    """
    feeds = faults.select(*KEY).union(views.select(*KEY)).distinct()
    # parts of TICKS ticks first, then the ticks of each, so that no row holds them all
    part = TICKS * step_ms
    heads = feeds.select(*KEY, F.explode(F.sequence(F.lit(first_ms), F.lit(last_ms), F.lit(part))).alias("_head"))
    ticks = heads.select(*KEY, F.explode(F.sequence(F.col("_head"), F.least(F.col("_head") + (part - step_ms), F.lit(last_ms)), F.lit(step_ms))).alias("t")).select(*KEY, "t", F.lit(2).alias("_o"))
    e = F.struct("id", "kind", "at_ms", "expected_seq", "got_seq", "reason", "duration_ms").alias("e")
    f = faults.select(*KEY, F.col("at_ms").alias("t"), F.lit(1).alias("_o"), F.col("id").alias("_i"), e)
    v = views.select(*KEY, F.col("at_ms").alias("t"), F.lit(0).alias("_o"), F.col("gen").alias("_i"), F.col("last_seq").alias("seq"))
    every = ticks.unionByName(f, allowMissingColumns=True).unionByName(v, allowMissingColumns=True)
    kind = F.col("e.kind")
    n = lambda cond: (SUM, cond.cast("bigint"))
    figures = {
        "seq": (LAST, F.col("seq")),
        "gaps": n(kind == "gap"),
        "resyncs": n(kind.isin(*S.REBUILD_KINDS)),
        "disconnects": n(kind == "disconnect"),
        "would_crosses": n(kind == "cross"),
        "checksum_mismatches": n((kind == "checksum") | (F.col("e.reason") == "snapshot checksum mismatch")),
        "snapshot_rejects": n(kind == "snapshot-reject"),
        "snapshot_errors": n(kind == "snapshot-error"),
        "n_events": n(F.col("e").isNotNull()),
    }
    rows = running(every, KEY, "t", figures, then=("_o", "_i"), stretch=part).fillna(0, list(figures))
    # the last 16 events before a tick are the fault rows numbered n_events - 15 to n_events
    numbered = rows.where("_o = 1").select(*KEY, F.col("n_events").alias("_n"), "e")
    at = rows.where("_o = 2").drop("e", "_o", "_i")
    wanted = at.select(*KEY, "t", F.explode(F.expr(f"case when n_events > 0 then sequence(greatest(n_events - {RING - 1}, 1), n_events) else array() end")).alias("_n"))
    lists = wanted.join(numbered, [*KEY, "_n"]).groupBy(*KEY, "t").agg(F.array_sort(F.collect_list("e")).alias("events"))
    return at.join(lists, [*KEY, "t"], "left").withColumn("events", F.coalesce("events", F.array().cast(EVENTS))).withColumn("rejected", F.lit(0).cast("bigint"))


def status_documents(feeds: DataFrame, counters: DataFrame, ages: DataFrame, delivery: DataFrame, latency: DataFrame) -> DataFrame:
    """The status document of each feed as JSON text: feeds has mode, chaos, version, depth and started_ms.

    A feed without latency samples has no latency block.
    """
    rows = feeds.join(counters, KEY, "left").join(ages, KEY, "left").join(delivery, KEY, "left").join(latency, KEY, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    doc = F.struct(
        F.lit(1).alias("schema"),
        "mode",
        "chaos",
        "version",
        "venue",
        "symbol",
        F.col("started_ms").alias("startedAtUnixMs"),
        "depth",
        F.coalesce("age_ms", F.lit(-1)).alias("lastEventAgeMs"),
        F.struct(*[n(c).alias(c) for c in ("consumers", "delivered", "dropped", "published")]).alias("delivery"),
        F.struct(n("gaps").alias("gaps"), n("resyncs").alias("resyncs"), n("disconnects").alias("disconnects"), n("would_crosses").alias("wouldCrosses"), n("checksum_mismatches").alias("checksumMismatches"), n("snapshot_rejects").alias("snapshotRejects"), n("snapshot_errors").alias("snapshotErrors"), n("rejected").alias("rejected")).alias("engine"),
        F.when(F.col("count") > 0, F.struct(F.col("count"), F.col("p50_ns").alias("p50Ns"), F.col("p99_ns").alias("p99Ns"), F.col("p999_ns").alias("p999Ns"), F.col("max_ns").alias("maxNs"))).alias("latency"),
    )
    return rows.select(*KEY, F.to_json(doc, {"ignoreNullFields": "true"}).alias("document"))
