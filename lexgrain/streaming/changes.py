"""Change streams: debounced batches of paths, index updates, searches over new rows."""

from __future__ import annotations

import os
import signal
import threading
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import index as index_ops
from ..operators.matching import eligible, matches
from ..plans.planner import QueryPlan
from ..schema import SearchOptions
from ..sources.files import list_files, load_files, read_files
from ..sources.walk import walk
from .state import IdleTracker, WatcherState

#: Silence that closes a batch of changes.
DEBOUNCE_MS = 500


def debounce(events: DataFrame, path: Column, ts: Column, silence_ms: int = DEBOUNCE_MS, slice_s: int = 3600, slice_rows: int = 500_000) -> DataFrame:
    """batch_start, batch_end, n_events, paths (distinct, sorted): a batch ends where nothing follows within silence_ms.

    Gaps are found within slices of time, each slice_s long or, where it has more than slice_rows events, an even part of that;
    only each slice's ends meet in one place to join batches across slices."""
    rows = events.select(path.alias("path"), F.unix_micros(ts).alias("us")).where(F.col("us").isNotNull())
    whole = slice_s * 1_000_000
    rows = rows.withColumn("from", F.floor(F.col("us") / F.lit(whole)) * whole)
    dense = rows.groupBy("from").agg(F.count(F.lit(1)).alias("n")).select("from", F.greatest(F.lit(1), F.floor(F.lit(whole) / F.ceil(F.col("n") / slice_rows))).alias("step"))
    rows = rows.join(dense, "from").select("path", "us", (F.col("from") + F.floor((F.col("us") - F.col("from")) / F.col("step")) * F.col("step")).alias("slice"))
    ends = rows.groupBy("slice").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    ends = ends.select("slice", F.lag("last").over(W.orderBy("slice")).alias("before"))
    w = W.partitionBy("slice").orderBy("us")
    gap = F.col("us") - F.coalesce(F.lag("us").over(w), F.col("before"))
    marked = rows.join(ends, "slice").withColumn("new", F.coalesce(gap >= silence_ms * 1000, F.lit(True)))
    heads = marked.withColumn("start", F.when(F.col("new"), F.col("us")))
    heads = heads.withColumn("start", F.max("start").over(w.rangeBetween(W.unboundedPreceding, 0)))
    carried = heads.groupBy("slice").agg(F.max("start").alias("s")).select("slice", F.max("s").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    placed = heads.join(carried, "slice").withColumn("start", F.coalesce("start", "carried"))
    out = placed.groupBy("start").agg(F.max("us").alias("end"), F.count(F.lit(1)).alias("n_events"), F.sort_array(F.collect_set("path")).alias("paths"))
    return out.select(F.timestamp_micros("start").alias("batch_start"), F.timestamp_micros("end").alias("batch_end"), "n_events", "paths")


def debounce_stream(events: DataFrame, path: Column, ts: Column, silence_ms: int = DEBOUNCE_MS, late: str = "10 seconds", feed: Column | None = None) -> DataFrame:
    """The same over a stream; a watermark bounds what is held. feed: batches are made for each of its values."""
    feed = feed if feed is not None else ts.isNotNull()  # sessions of a stream need a key
    rows = events.select(path.alias("path"), ts.alias("ts"), feed.alias("feed")).withWatermark("ts", late)
    sessions = rows.groupBy("feed", F.session_window("ts", f"{silence_ms} milliseconds"))
    out = sessions.agg(F.min("ts").alias("batch_start"), F.max("ts").alias("batch_end"), F.count(F.lit(1)).alias("n_events"), F.sort_array(F.collect_set("path")).alias("paths"))
    return out.drop("session_window", "feed")


def search_stream(files: DataFrame, plan: QueryPlan, options: SearchOptions) -> DataFrame:
    """Matches of a stream of files(path, ext, text): the search is stateless, so any output mode will do."""
    return matches(eligible(files, options), plan, options)


def index_stream(changes: DataFrame, source: Callable[[], DataFrame], root: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Updates the index at root for every micro-batch of changes; source() reads what is there now."""

    def apply(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            index_ops.update(source(), root)

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{DEBOUNCE_MS} milliseconds")).start()


class Watcher:
    """Polls a folder; a file source sees neither changes in place nor deletions."""

    def __init__(self, root: str, poll_s: float = 0.1, silence_ms: int = DEBOUNCE_MS):
        self.root, self.poll_s, self.silence_s = root, poll_s, silence_ms / 1000
        self.seen = self._snapshot()
        self._stop = threading.Event()

    def _snapshot(self) -> dict[str, tuple[int, int]]:
        return {f.path: (f.mtime_ns, f.size) for f in walk(self.root)}

    def poll(self) -> set[str]:
        """Paths that were created, modified or removed since the last call."""
        now = self._snapshot()
        changed = {p for p in self.seen.keys() | now.keys() if self.seen.get(p) != now.get(p)}
        self.seen = now
        return changed

    def next_batch(self, timeout_s: float) -> list[str]:
        """Distinct changed paths up to the first silence; none after timeout_s without a change."""
        batch: set[str] = set()
        began = last = time.monotonic()
        while not self._stop.is_set():
            changed = self.poll()
            now = time.monotonic()
            if changed:
                batch |= changed
                last = now
            elif batch and now - last >= self.silence_s or not batch and now - began >= timeout_s:
                break
            time.sleep(self.poll_s)
        return sorted(batch)

    def stop(self) -> None:
        self._stop.set()

    @property
    def is_running(self) -> bool:
        return not self._stop.is_set()


def run_watcher(spark: SparkSession, root: str, index_root: str, watcher: Watcher | None = None, rounds: int | None = None, decompress: bool = False) -> IdleTracker:
    """Builds the index, then updates it after each batch of changes until the watcher stops, also by SIGTERM (or for some rounds)."""
    watcher, tracker = watcher or Watcher(root), IdleTracker()
    state = WatcherState.new(os.path.abspath(root))
    state.write(index_root)
    main = threading.current_thread() is threading.main_thread()
    before = signal.signal(signal.SIGTERM, lambda *_: watcher.stop()) if main else None
    try:
        index_ops.build(read_files(spark, root, decompress), f"{index_root}/index")
        while watcher.is_running and rounds != 0:
            changed = watcher.next_batch(5.0)
            rounds = None if rounds is None else rounds - 1
            if changed:
                tracker.record_change()
                state.status, state.last_event_at = "indexing", int(time.time())
                state.write(index_root)
                index_ops.update(list_files(spark, root), f"{index_root}/index", lambda listed: load_files(listed, root, decompress))
            state.status = "idle"
            state.write(index_root)
    finally:
        watcher.stop()
        WatcherState.remove(index_root)
        if main:
            signal.signal(signal.SIGTERM, before)
    return tracker
