"""Bounded sample queues with staleness, as a fold over ordered events.

Events are (seq, kind, version): ``put`` brings a sample, ``get`` takes one.  The same fold
runs in batch (one group a queue) and in Structured Streaming (state a queue), so a replay
of the log gives what the stream gave.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "queue string, seq bigint, kind string, item bigint, size bigint, dropped bigint, produced bigint, consumed bigint"
_COLUMNS = ["queue", "seq", "kind", "item", "size", "dropped", "produced", "consumed"]


class BoundedQueue:
    """First in, first out; when full, a put drops the oldest sample first.  Without a capacity nothing is dropped."""

    def __init__(self, capacity: int | None, items=(), produced: int = 0, consumed: int = 0, dropped: int = 0):
        self.capacity, self.items = capacity, deque(items)
        self.produced, self.consumed, self.dropped = produced, consumed, dropped

    def put(self, item) -> bool:
        """False if another sample had to go."""
        full = self.capacity is not None and len(self.items) >= self.capacity
        if full:
            self.items.popleft()
            self.dropped += 1
        self.items.append(item)
        self.produced += 1
        return not full

    def get(self):
        """The oldest sample, null if there is none."""
        if not self.items:
            return None
        self.consumed += 1
        return self.items.popleft()

    def take(self, n: int):
        """Exactly n samples, or null and nothing taken."""
        return [self.get() for _ in range(n)] if len(self.items) >= n else None


def _fold(queue: BoundedQueue, name: str, events: pd.DataFrame) -> list[tuple]:
    out = []
    for seq, kind, item in events.sort_values("seq")[["seq", "kind", "item"]].itertuples(index=False):
        taken = item if kind == "put" else None
        if kind == "put":
            queue.put(item)
        elif kind == "get":
            taken = queue.get()
        out.append((name, seq, kind, taken, len(queue.items), queue.dropped, queue.produced, queue.consumed))
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS).astype({"item": "Int64"})


def folded(rows: DataFrame, key: str, order: list[str], start: Callable, step: Callable, schema: str) -> DataFrame:
    """A sequential fold over the rows of each ``key`` in ``order``: keys in parallel, rows of one key batch by batch.

    ``start()`` makes the state of a key, ``step(state, frame)`` folds a sorted frame of
    one key into it and returns the rows it yields.  Rows are sorted by Spark (with
    spilling); a task holds one batch and one state, never a key's whole history.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for frame in frames:
            if not len(frame):
                continue
            names = frame[key]
            change = (names != names.shift()) & ~(names.isna() & names.shift().isna())
            change.iloc[0] = False
            for _, part in frame.groupby(change.cumsum().to_numpy(), sort=False):
                name = part[key].iloc[0]
                if state is None or not (name == at or (pd.isna(name) and pd.isna(at))):
                    at, state = name, start()
                yield step(state, part)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def replay(events: DataFrame, capacity: int | None) -> DataFrame:
    """The state after each event of each queue (queue, seq, kind, item), queues in parallel.

    ``put`` brings an item, ``get`` takes the oldest (null if there is none).  A side
    queue, such as that of validation samples, is a queue of its own name without a
    capacity.  Events of other kinds change nothing; ``seq`` must be unique in a queue.
    """

    def step(queue: BoundedQueue, part: pd.DataFrame) -> pd.DataFrame:
        return _frame(_fold(queue, part["queue"].iloc[0], part))

    return folded(events.select("queue", "seq", "kind", "item"), "queue", ["seq"], lambda: BoundedQueue(capacity), step, OUT)


def streaming(events: DataFrame, capacity: int) -> DataFrame:
    """``replay`` over a stream: the queue's samples and counters are its state; events of a trigger go by ``seq``."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items, produced, consumed, dropped = state.get if state.exists else ([], 0, 0, 0)
        queue = BoundedQueue(capacity, items, produced, consumed, dropped)
        rows = _fold(queue, key[0], pd.concat(list(parts)))
        state.update((list(queue.items), queue.produced, queue.consumed, queue.dropped))
        yield _frame(rows)

    return events.groupBy("queue").applyInPandasWithState(run, OUT, "items array<bigint>, produced bigint, consumed bigint, dropped bigint", "append", GroupStateTimeout.NoTimeout)


def staleness_limit(required: int, threshold: float, sync_steps: int) -> int:
    """How many samples may be under way before production pauses."""
    return int(required * (threshold + 1) * sync_steps)


def pauses(events: DataFrame, limit: int, capacity: int) -> DataFrame:
    """Adds to ``put`` events ``stale`` (samples sent since the last version) and ``paused`` (queue full or stale at the limit).

    ``events`` is ``replay``'s result with a ``version``; a new version starts the count at
    the samples still queued.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("queue").orderBy("seq")
    fresh = F.when(F.col("version") > F.lag("version", 1).over(w), 1).otherwise(0)
    span = events.withColumn("__new", fresh).withColumn("__span", F.sum("__new").over(w))
    inner = Window.partitionBy("queue", "__span").orderBy("seq")
    held = F.first(F.when(F.col("__new") == 1, F.col("size")).otherwise(F.lit(0))).over(inner)
    puts = F.sum(F.when((F.col("kind") == "put") & (F.col("__new") == 0), 1).otherwise(0)).over(inner.rowsBetween(Window.unboundedPreceding, 0))
    out = span.withColumn("stale", held + puts)
    return out.withColumn("paused", (F.col("stale") >= limit) | (F.col("size") >= capacity)).drop("__new", "__span")


def stale_counts(samples: DataFrame, version="version", current="current_version") -> DataFrame:
    """One row: samples, those made under an older version, and their share."""
    old = F.count_if(F.col(current) - F.col(version) >= 1)
    return samples.agg(F.count(F.lit(1)).alias("samples"), old.alias("stale"), (old / F.count(F.lit(1))).alias("stale_share"))


def resume_order(samples: DataFrame, cancelled="cancelled", seq="seq") -> DataFrame:
    """Adds ``place``: cancelled samples first, each kind in the order of ``seq``; ``counts`` marks those that add to staleness.

    ``seq`` is a unique number; a null ``cancelled`` counts as false.
    """
    from corpusmill.functions.ranking import ranked_in_order

    late = F.when(F.col(cancelled), 0).otherwise(1)
    placed = ranked_in_order(samples.withColumn("__late", late), seq, "place", by=["__late"], across=True)
    return placed.withColumn("counts", F.col("__late") == 1).drop("__late")


def count_windows(rows: DataFrame, size: int, seq="seq") -> DataFrame:
    """Adds ``window``: runs of ``size`` rows by ordinal (tumbling by count)."""
    return rows.withColumn("window", F.floor(F.col(seq) / size).cast("bigint"))


def ready_samples(cells: DataFrame, fields: list[str], consumed: DataFrame | None = None, sample="sample", field="field") -> DataFrame:
    """(sample): samples whose required fields have all been produced and that the task has not consumed.

    ``cells`` holds one event a cell (sample, field, value); a null value is not produced.
    """
    have = cells.filter(F.col(field).isin(fields) & F.col("value").isNotNull()).groupBy(sample).agg(F.count_distinct(field).alias("n")).filter(F.col("n") == len(fields)).select(sample)
    return have.join(consumed.select(sample).distinct(), sample, "left_anti") if consumed is not None else have


def get_fields(cells: DataFrame, samples: DataFrame, fields: list[str], sample="sample", field="field") -> DataFrame:
    """The required fields of the given samples, a column each; a cell written twice keeps its latest value."""
    newest = cells.join(samples, sample, "left_semi").filter(F.col(field).isin(fields)).groupBy(sample, field).agg(F.max_by("value", "seq").alias("value"))
    return newest.groupBy(sample).pivot(field, fields).agg(F.first("value"))


def token_bucket(requests: DataFrame, rate: float, capacity: float, key="bucket", at="at", cost="cost") -> DataFrame:
    """(bucket, at, cost, start): when each request may start, if tokens refill at ``rate`` a second up to ``capacity``.

    Requests of a bucket are served in order of arrival; one that costs more than the
    capacity waits until its tokens have come in.
    """
    schema = f"{key} string, {at} double, {cost} double, start double"

    def step(state: list, pdf: pd.DataFrame) -> pd.DataFrame:
        tokens, now = state
        starts = []
        for t, c in zip(pdf[at], pdf[cost]):
            t = max(t, now)
            tokens = min(capacity, tokens + (t - now) * rate)
            wait = max(0.0, (c - tokens) / rate)
            now, tokens = t + wait, tokens + wait * rate - c
            starts.append(now)
        state[:] = tokens, now
        return pdf.assign(start=starts)[[key, at, cost, "start"]]

    return folded(requests.select(key, at, cost), key, [at, cost], lambda: [capacity, 0.0], step, schema)


def event_windows(events: DataFrame, width: str, late: str, at="ts", by: list[str] = ()) -> DataFrame:
    """Counts and sums of ``value`` in event-time windows with a watermark (an extension: versions count in the queues)."""
    timed = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    return timed.groupBy(F.window("__at", width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def full_batches(puts: DataFrame, required: int, queue="queue", seq="seq") -> DataFrame:
    """Adds ``batch``: samples of a queue taken ``required`` at a time, oldest first; the rest, too few for a batch, is left.

    ``seq`` is a number, unique within a queue.
    """
    from corpusmill.functions.ranking import ranked_in_order

    placed = ranked_in_order(puts, seq, "__k", by=[queue]).withColumn("batch", F.floor(F.col("__k") / required).cast("bigint")).drop("__k")
    sizes = placed.groupBy(queue, "batch").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == required).select(queue, "batch")
    return placed.join(sizes, [queue, "batch"])
