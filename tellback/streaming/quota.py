"""Fixed windows anchored at a key's first request (quotas, result reuse): batch and stream.

A window opens with the first request after the previous one ended, so windows depend on each other in time order. What a stretch of time does to them is
a function: from the end of the window that is open when it begins to the end of the window that is open when it is over. That function is a step
function of the stretch's request times, and functions of neighbouring stretches compose. So the batch job

* gathers a key's distinct milliseconds per piece of time (``PIECE_MS``, which bounds a row whatever the traffic),
* cuts the time line of a busy key into blocks (about ``BLOCK_MOMENTS`` distinct milliseconds each) and makes each block's function in a task of its own,
* composes the functions of ``FAN`` neighbours, level by level, to a tree, and goes down again with the window that is open at the beginning of each node,
* and then walks all blocks on their own, each from its known open window.

Keys of one block take the last step only. Requests are matched to windows by (key, bucket) and numbered by slices of a window, so a hot key is spread
over its buckets and slices there, too.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellback.sources.sinks import store

ANCHORS = "key string, anchor long"
#: Length of the pieces of time whose moments are one row.
PIECE_MS = 2_000
#: Slices of a window in which its requests are numbered on their own.
SLICES = 64
#: Distinct milliseconds of a block, about.
BLOCK_MOMENTS = 1 << 16
#: Children of a node in the tree of functions.
FAN = 16
#: Steps of a block's function that one task makes; a block whose first window length has more is made by several tasks.
STEPS = 1 << 20
#: The end of a window that was never open.
NEVER = -(1 << 62)


# --- functions of stretches of time -------------------------------------------------------
# A function is three arrays of its steps in ascending order: an end e above at[i - 1] and up to at[i] goes to to[i], but the last run[i] integers up to at[i] go to
# different values, one apart: requests on consecutive milliseconds are one step.
Steps = tuple[np.ndarray, np.ndarray, np.ndarray]


def steps(at: np.ndarray, to: np.ndarray, run: np.ndarray | None = None) -> Steps:
    """The same function with as few steps as it takes; ``at`` is ascending, and runs of different steps don't overlap."""
    run = np.ones(len(at), np.int64) if run is None else run
    if len(at):  # neighbours with one value
        last = np.append((to[1:] != to[:-1]) | (run[1:] > 1) | (run[:-1] > 1), True)
        at, to, run = at[last], to[last], run[last]
        # neighbours that continue each other
        goes_on = (at[1:] - at[:-1] == run[1:]) & (to[1:] - to[:-1] == run[1:])
        first = np.flatnonzero(np.append(True, ~goes_on))
        last = np.append(first[1:], len(at)) - 1
        at, to, run = at[last], to[last], np.add.reduceat(run, first)
    return at, to, run


def applied(function: Steps, ends: np.ndarray) -> np.ndarray:
    """The function's values; ends above its last step are of windows that outlast the stretch and stay."""
    at, to, run = function
    if not len(at):
        return ends
    k = np.searchsorted(at, ends)
    known = np.minimum(k, len(at) - 1)
    return np.where(k < len(at), to[known] - np.minimum(at[known] - np.minimum(ends, at[known]), run[known] - 1), ends)


def _after(first: Steps, second: Steps) -> Steps:
    """The function of two stretches, one after the other."""
    at, to, run = first
    # places where the composed function can change: steps of the first, and ends that it brings to a step of the second
    marks = np.union1d(second[0], second[0] - second[2] + 1)
    low, high = np.searchsorted(marks, to - run + 1), np.searchsorted(marks, to, side="right")
    count = high - low
    hit = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
    back = np.repeat(at - to, count) + marks[hit]
    points = np.union1d(np.concatenate((at, at - run + 1)), back)
    value = lambda e: applied(second, applied(first, e))
    top, bottom = value(points), value(np.append(points[:1], points[:-1] + 1))
    return steps(points, top, np.where(top == bottom, 1, np.diff(points, prepend=points[:1] - 1)))


def composed(parts: list[Steps]) -> Steps:
    out = parts[0]
    for part in parts[1:]:
        out = _after(out, part)
    return out


class Stretch:
    """The function of a stretch of time, built from its pieces in time order.

    Entries are the ends of open windows that make a difference: the request times from ``low`` on and below ``high``, at most a window length in all, and, if it is
    the ``last`` chunk of the stretch, ``high``. Ends that have come to be equal are followed as one.
    """

    def __init__(self, low: int, high: int, last: bool, window_ms: int):
        self.low, self.high, self.last, self.window = low, high, last, window_ms
        self.entries: list[np.ndarray] = []
        #: Open windows in ascending order of their ends: ends, and the number of the first entry that came to it.
        self.queue: deque[tuple[np.ndarray, np.ndarray]] = deque()
        #: Entries that follow another one from some piece on, and which.
        self.merged: list[tuple[np.ndarray, np.ndarray]] = []
        self.count = 0

    def _new(self, ends: np.ndarray) -> np.ndarray:
        self.entries.append(ends)
        self.count += len(ends)
        return np.arange(self.count - len(ends), self.count)

    def piece(self, times: np.ndarray) -> None:
        """Request times of the next piece, ascending and distinct; a piece is not longer than a window."""
        fresh = times[(times >= self.low) & (times < self.high)]
        if self.last and times[-1] >= self.high:
            fresh, self.last = np.append(fresh, self.high), False
        ends, ids = [fresh], [self._new(fresh)]
        while self.queue and self.queue[0][0][0] <= times[-1]:
            e, i = self.queue.popleft()
            n = int(np.searchsorted(e, times[-1], side="right"))
            ends.append(e[:n])
            ids.append(i[:n])
            if n < len(e):
                self.queue.appendleft((e[n:], i[n:]))
                break
        e, i = np.concatenate(ends), np.concatenate(ids)
        if not len(e):
            return
        opened, first, same = np.unique(times[np.searchsorted(times, e)], return_index=True, return_inverse=True)
        to = i[first][same.ravel()]
        self.merged.append((i[to != i], to[to != i]))
        self.queue.append((opened + self.window, i[first]))

    def function(self) -> Steps:
        if self.last:  # no request since
            high = np.array([self.high], np.int64)
            self.queue.appendleft((high, self._new(high)))
        if not self.count:
            return steps(np.zeros(0, np.int64), np.zeros(0, np.int64))
        into, ends = np.arange(self.count), np.zeros(self.count, np.int64)
        for i, to in self.merged:
            into[i] = to
        while (into != into[into]).any():
            into = into[into]
        for e, i in self.queue:
            ends[i] = e
        return steps(np.concatenate(self.entries), ends[into])


# --- windows of all keys ------------------------------------------------------------------
def moments(events: DataFrame, window_ms: int) -> DataFrame:
    """A key's distinct milliseconds per piece of time, with the window length (slot) it lies in."""
    slot = F.floor(F.col("ms") / window_ms)
    piece = F.floor((F.col("ms") - slot * window_ms) / min(PIECE_MS, window_ms))
    # distinct milliseconds first: partial aggregation removes repeats before the shuffle
    return (
        events.select("key", slot.alias("slot"), piece.alias("piece"), "ms")
        .distinct()
        .groupBy("key", "slot", "piece")
        .agg(F.array_sort(F.collect_list("ms")).alias("moments"))
    )


def _keys(pieces: DataFrame, block_moments: int) -> DataFrame:
    """Keys with more moments than a block has: their first window length, window lengths in a block, and chunks (see ``_blocks``)."""
    slots = pieces.groupBy("key", "slot").agg(F.sum(F.size("moments")).alias("n"))
    keys = slots.groupBy("key").agg(F.sum("n").alias("of"), F.max("n").alias("most"), F.min("slot").alias("first"), F.max("slot").alias("last"))
    wide = F.greatest(F.lit(1), F.floor((F.col("last") - F.col("first") + 1) * block_moments / F.col("of")))
    return keys.where(F.col("of") > block_moments).select("key", "first", wide.cast("long").alias("wide"), F.ceil(F.col("most") / STEPS).alias("chunks"))


def _blocks(pieces: DataFrame, window_ms: int) -> DataFrame:
    """Pieces of busy keys for each block's function, and the range of entries that a task looks at.

    Entries are cut into ``chunks``. Where a block is one window length, a chunk only needs its own pieces: windows that open there end behind the block.
    """
    length = min(PIECE_MS, window_ms)
    of = -(-window_ms // length)
    own = F.floor(F.col("piece") * F.col("chunks") / of).cast("long")
    chunk = F.explode(F.when(F.col("wide") == 1, F.array(own)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    low = lambda c: F.least(F.ceil(c * of / F.col("chunks")) * length, F.lit(window_ms))
    start = (F.col("first") + F.col("block") * F.col("wide")) * window_ms
    rows = pieces.withColumn("chunk", chunk)
    return rows.select("key", "block", "chunk", "slot", "piece", "moments", (start + low(F.col("chunk"))).alias("low"), (start + low(F.col("chunk") + 1)).alias("high"), (F.col("chunk") == F.col("chunks") - 1).alias("is_last"))


FUNCTION = "key string, node long, chunk long, at array<long>, to array<long>, run array<long>"
_LONGS = pa.list_(pa.int64())


def _row(key: str, node: int, chunk: int, function: Steps) -> pa.RecordBatch:
    lists = [pa.array([x], _LONGS) for x in function]
    return pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([node], pa.int64()), pa.array([chunk], pa.int64()), *lists], names=["key", "node", "chunk", "at", "to", "run"])


def _made(window_ms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by key, block, chunk and time."""
        now, stretch = None, None
        for batch in batches:
            *columns, times = batch.columns
            for k, (key, block, chunk, low, high, is_last) in enumerate(zip(*[c.to_pylist() for c in columns])):
                if (key, block, chunk) != now:
                    if stretch is not None:
                        yield _row(*now, stretch.function())
                    now, stretch = (key, block, chunk), Stretch(low, high, is_last, window_ms)
                stretch.piece(times[k].values.to_numpy(zero_copy_only=False))
        if stretch is not None:
            yield _row(*now, stretch.function())

    return run


def _children(table: pa.Table) -> list[tuple[int, Steps]]:
    """Children in time order with their functions; the chunks of one child follow each other."""
    out: dict[int, list[Steps]] = {}
    for node, _, k in sorted(zip(table["node"].to_pylist(), table["chunk"].to_pylist(), range(table.num_rows))):
        out.setdefault(node, []).append(tuple(table[c][k].values.to_numpy(zero_copy_only=False) for c in ("at", "to", "run")))
    return [(node, steps(*[np.concatenate([p[c] for p in parts]) for c in range(3)])) for node, parts in out.items()]


def _compose(table: pa.Table) -> pa.Table:
    parts = _children(table)
    return pa.Table.from_batches([_row(table["key"][0].as_py(), parts[0][0] // FAN, 0, composed([f for _, f in parts]))])


def _descend(left: pa.Table, right: pa.Table) -> pa.Table:
    """The end of the window that is open when each child begins, from that of its parent (``left``)."""
    end = left["end"][0].as_py() if left.num_rows else NEVER
    nodes, ends = [], []
    for node, function in _children(right) if right.num_rows else []:
        nodes.append(node)
        ends.append(end)
        end = int(applied(function, np.array([end]))[0])
    keys = [right["key"][0].as_py()] * len(nodes) if nodes else []
    return pa.table({"key": pa.array(keys, pa.string()), "node": pa.array(nodes, pa.int64()), "end": pa.array(ends, pa.int64())})


def _parent() -> Column:
    return F.floor(F.col("node") / FAN).cast("long").alias("parent")


def _open_windows(blocks: DataFrame, high: int, window_ms: int) -> DataFrame:
    """key, block and the end of the window that is open when the block begins. ``high`` is the largest block number."""
    ordered = blocks.repartition("key", "block", "chunk").sortWithinPartitions("key", "block", "chunk", "slot", "piece")
    made = ordered.select("key", "block", "chunk", "low", "high", "is_last", "moments").mapInArrow(_made(window_ms), FUNCTION)
    levels = [store(made, "functions")]
    while high >= FAN:
        high //= FAN
        levels.append(store(levels[-1].groupBy("key", _parent()).applyInArrow(_compose, FUNCTION), "functions"))
    ends = levels[-1].limit(0).select("key", F.col("node").alias("parent"), F.col("node").alias("end"))  # nothing is above the top
    for level in reversed(levels):
        below = ends.groupBy("key", "parent").cogroup(level.withColumn("parent", _parent()).groupBy("key", "parent"))
        found = store(below.applyInArrow(_descend, "key string, node long, end long"), "ends")
        ends = found.withColumnRenamed("node", "parent")
    return found.withColumnRenamed("node", "block")


def _walk(window_ms: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come ordered by key, block and time; ``end`` is that of the window open when the block begins."""
        now, end = None, NEVER
        for batch in batches:
            keys: list[str] = []
            anchors: list[int] = []
            for k, block, opened, times in zip(batch["key"], batch["block"], batch["end"], batch["moments"]):
                if (k, block) != now:
                    now, end = (k, block), int(opened)
                times = np.asarray(times, dtype=np.int64)
                at = int(np.searchsorted(times, end))
                while at < len(times):
                    start = int(times[at])
                    keys.append(k)
                    anchors.append(start)
                    end = start + window_ms
                    at = int(np.searchsorted(times, end))
            if keys:  # an empty frame has no types
                yield pd.DataFrame({"key": keys, "anchor": np.array(anchors, dtype=np.int64)})

    return run


def anchors(events: DataFrame, window_ms: int, block_moments: int = BLOCK_MOMENTS) -> DataFrame:
    """Window starts per key. ``events`` has key (string) and ms (long); rows without either have no window."""
    pieces = store(moments(events.where("key is not null and ms is not null"), window_ms), "moments")
    busy = store(_keys(pieces, block_moments), "busy")
    never = F.lit(NEVER).cast("long")
    rows = pieces.withColumns({"block": F.lit(0).cast("long"), "end": never})
    if busy.limit(1).count():
        of_busy = pieces.join(busy, "key").withColumn("block", F.floor((F.col("slot") - F.col("first")) / F.col("wide")).cast("long"))
        high = of_busy.agg(F.max("block")).first()[0]
        ends = _open_windows(_blocks(of_busy, window_ms), high, window_ms)
        cut = of_busy.join(ends, ["key", "block"]).select("key", "slot", "piece", "moments", "block", "end")
        rows = rows.join(busy.select("key"), "key", "left_anti").select(*cut.columns).unionByName(cut)
    ordered = rows.repartition("key", "block").sortWithinPartitions("key", "block", "slot", "piece")
    return ordered.select("key", "block", "end", "moments").mapInPandas(_walk(window_ms), ANCHORS)


def windowed(events: DataFrame, window_ms: int, order: str) -> DataFrame:
    """Every event with its window start and its number inside the window."""
    starts = anchors(events, window_ms).select(
        "key",
        "anchor",
        F.explode(
            F.sequence(F.floor(F.col("anchor") / window_ms), F.floor((F.col("anchor") + window_ms - 1) / window_ms))
        ).alias("bucket"),
    )
    placed = (
        events.withColumn("bucket", F.floor(F.col("ms") / window_ms))
        .join(starts, ["key", "bucket"])
        .filter((F.col("ms") >= F.col("anchor")) & (F.col("ms") < F.col("anchor") + window_ms))
        .drop("bucket")
    )
    placed = placed.withColumn("slice", F.floor((F.col("ms") - F.col("anchor")) * SLICES / window_ms))
    # at most SLICES counts per window; their running sum is where the numbers of a slice start
    counts = placed.groupBy("key", "anchor", "slice").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("key", "anchor").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("key", "anchor", "slice", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    w = Window.partitionBy("key", "anchor", "slice").orderBy("ms", order)
    numbered = placed.withColumn("in_slice", F.row_number().over(w)).join(before, ["key", "anchor", "slice"])
    return numbered.withColumn("nth", F.col("before") + F.col("in_slice")).drop("slice", "in_slice", "before")


def quota_windows(events: DataFrame, window_ms: int, most: int, order: str) -> DataFrame:
    """allowed, remaining and seconds to reset for every request."""
    left = F.col("anchor") + window_ms - F.col("ms")
    return windowed(events, window_ms, order).select(
        "key",
        order,
        F.col("nth").cast("bigint").alias("request_no"),
        (F.col("nth") <= most).alias("allowed"),
        F.greatest(F.lit(most) - F.col("nth"), F.lit(0)).cast("bigint").alias("remaining"),
        F.ceil(left / 1000.0).cast("bigint").alias("reset_seconds"),
    )


def freshness_reuse(events: DataFrame, ttl_ms: int, order: str) -> DataFrame:
    """hit when the same key was computed within the time to live; a hit does not extend it."""
    return windowed(events, ttl_ms, order).select("key", order, (F.col("nth") > 1).alias("hit"))


# --- streams ------------------------------------------------------------------------------
#: Groups that the streams deal keys to. Calls to the state cost about a millisecond, so a group's keys share them. A started stream keeps its number of groups.
GROUPS = 1 << 12
#: Records beyond two a key after which a group's list is written anew.
SPARE_RECORDS = 64


def _in_order(rows, order: str) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a group's rows in a micro-batch, where the rows of each begin (and the last end), and times and ids (16 bytes a row) in order; rows may come in several frames in any order."""
    number: dict = {}
    parts = []
    for frame in rows:
        code, names = pd.factorize(frame["key"], use_na_sentinel=False)
        own = np.array([number.setdefault(None if pd.isna(n) else n, len(number)) for n in names], np.int64)
        parts.append(np.column_stack((own[code], frame[["ms", order]].astype("int64").to_numpy())))
    asked = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
    asked = asked[np.lexsort((asked[:, 2], asked[:, 1], asked[:, 0]))]
    return list(number), np.searchsorted(asked[:, 0], np.arange(len(number) + 1)), asked[:, 1], asked[:, 2]


def _named(names: list, begin: np.ndarray) -> np.ndarray:
    """The key of each row."""
    return np.repeat(np.array(names, dtype=object), np.diff(begin))


def _dealt(events: DataFrame, *columns: str):
    """Rows grouped for the streams: all rows of a key are in one of ``GROUPS`` groups."""
    return events.select("key", *columns, F.pmod(F.xxhash64("key"), F.lit(GROUPS)).alias("group")).groupBy("group")


def quota_processor(window_ms: int, most: int, order: str, timed: bool = False):
    """Stateful processor of the same rule for a stream: state is (count, reset time) per key, a list per group of keys whose last record of a key counts.

    With ``timed`` a timer drops a group's states once the watermark has passed their windows' ends.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Quota(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.windows = handle.getListState("windows", "key string, count long, reset long")

        def _known(self) -> tuple[dict, int]:
            records = list(self.windows.get()) if self.windows.exists() else []
            return {name: (int(count), int(reset)) for name, count, reset in records}, len(records)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            names, begin, times, ids = _in_order(rows, order)
            if not len(ids):
                return
            known, records = self._known()
            numbers, resets = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for name, at, end in zip(names, begin[:-1].tolist(), begin[1:].tolist()):
                count, reset = known.get(name, (0, 0))
                while at < end:  # one step per window
                    if count == 0 or reset <= times[at]:
                        count, reset = 0, int(times[at]) + window_ms
                    stop = at + int(np.searchsorted(times[at:end], reset))
                    numbers[at:stop] = np.arange(count + 1, count + 1 + stop - at)
                    resets[at:stop] = reset
                    count, at = count + stop - at, stop
                known[name] = count, reset
            if records + len(names) > 2 * len(known) + SPARE_RECORDS:
                self.windows.put([(name, *state) for name, state in known.items()])
            else:
                self.windows.appendList([(name, *known[name]) for name in names])
            if timed:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(min(reset for _, reset in known.values()))
            yield pd.DataFrame(
                {
                    "key": _named(names, begin),
                    order: ids,
                    "request_no": numbers,
                    "allowed": numbers <= most,
                    "remaining": np.maximum(most - numbers, 0),
                    "reset_seconds": -(-(resets - times) // 1000),
                }
            )

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            passed = timerValues.getCurrentWatermarkInMs()
            open_ones = {name: state for name, state in self._known()[0].items() if state[1] > passed}
            if open_ones:
                self.windows.put([(name, *state) for name, state in open_ones.items()])
                self.handle.registerTimer(min(reset for _, reset in open_ones.values()))
            else:
                self.windows.clear()
            yield from ()

        def close(self) -> None:
            pass

    return Quota()


def reuse_processor(ttl_ms: int, order: str, kept_ms: int):
    """Stateful processor of result reuse: a miss stores when its result ends, with a time to live, so that state leaves without timers.

    State is a list per group of keys whose last record of a key counts. Whether a result is fresh is judged by the requests' own time; the state's time to live
    (``kept_ms``, by the clock) only has to be longer than that. A record keeps the time it leaves, as one that is written anew gets a new time to live.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Reuse(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.fresh = handle.getListState("fresh", "key string, until long, leaves long", kept_ms)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            names, begin, times, ids = _in_order(rows, order)
            if not len(ids):
                return
            now = int(timerValues.getCurrentProcessingTimeInMs())
            records = list(self.fresh.get()) if self.fresh.exists() else []
            known = {name: (int(until), int(leaves)) for name, until, leaves in records if leaves > now}
            hits, missed = np.ones(len(ids), bool), []
            for name, at, end in zip(names, begin[:-1].tolist(), begin[1:].tolist()):
                until, before = known[name][0] if name in known else None, len(missed)
                while at < end:  # one step per miss
                    if until is None or until <= times[at]:
                        until, hits[at] = int(times[at]) + ttl_ms, False
                        del missed[before:]
                        missed.append(name)
                    at += int(np.searchsorted(times[at:end], until))
                if len(missed) > before:  # a hit does not extend it
                    known[name] = until, now + kept_ms
            if len(records) + len(missed) > 2 * len(known) + SPARE_RECORDS:
                self.fresh.put([(name, *state) for name, state in known.items()])
            elif missed:
                self.fresh.appendList([(name, *known[name]) for name in missed])
            yield pd.DataFrame({"key": _named(names, begin), order: ids, "hit": hits})

        def close(self) -> None:
            pass

    return Reuse()


def _keyed_state(events: DataFrame) -> None:
    # this kind of state needs the RocksDB store; state files follow the query's checkpoint folder
    events.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def quota_stream(events: DataFrame, window_ms: int, most: int, order: str, late: str | None = None) -> DataFrame:
    """Streaming quota decisions.

    Requests of a key are put in order within a micro-batch and are expected in time order across micro-batches. With ``late`` (an
    interval such as "1 hour") rows later than that are dropped, and ended windows leave the state.
    """
    if late:
        events = events.withColumn("ts", F.timestamp_millis("ms")).withWatermark("ts", late)
    _keyed_state(events)
    schema = f"key string, {order} long, request_no long, allowed boolean, remaining long, reset_seconds long"
    return _dealt(events, order, "ms", *(["ts"] if late else [])).transformWithStateInPandas(
        statefulProcessor=quota_processor(window_ms, most, order, late is not None),
        outputStructType=schema,
        outputMode="Append",
        timeMode="EventTime" if late else "None",
    )


def freshness_stream(events: DataFrame, ttl_ms: int, order: str, kept_ms: int | None = None) -> DataFrame:
    """Streaming result reuse: ``freshness_reuse`` for requests as they come.

    Requests of a key are put in order within a micro-batch and are expected in time order across micro-batches. State has a record per key and miss, which leaves
    ``kept_ms`` after the miss by the clock (twice the time to live unless given; it has to cover how much later than the request the stream may run).
    """
    _keyed_state(events)
    return _dealt(events, order, "ms").transformWithStateInPandas(
        statefulProcessor=reuse_processor(ttl_ms, order, kept_ms or 2 * ttl_ms),
        outputStructType=f"key string, {order} long, hit boolean",
        outputMode="Append",
        timeMode="ProcessingTime",
    )
