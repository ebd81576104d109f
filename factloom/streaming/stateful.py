"""Stateful operators: limiter, breaker, budget, key pool, and event-time windows (ST1 to ST7)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.config import DEFAULT


def allow(hits: list[float], now: float, limit: int, window: float) -> tuple[bool, int, list[float]]:
    """One request against a sliding window: (allowed, seconds to wait, hits that count from here on). Denials leave no trace."""
    hits = [h for h in hits if now - h < window]
    if limit <= 0 or len(hits) < limit:
        return True, 0, [*hits, now]
    return False, max(1, int(window - (now - hits[0]))), hits


def limited(requests: DataFrame, limit: int = DEFAULT.limiter_per_minute, window: float = 60.0) -> DataFrame:
    """Requests (client, request_id, at in seconds) with `allowed` and `retry_after`, replayed by client (ST2).

    What a client may do depends on what it was allowed before, so its requests are read in order, in bounded batches with the
    window's hits as the only state.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, hits = None, []
        for frame in frames:
            out = []
            for c, at in zip(frame["client"], frame["at"]):
                if c != client:
                    client, hits = c, []
                ok, wait, hits = allow(hits, at, limit, window)
                out.append((ok, wait))
            frame["allowed"], frame["retry_after"] = [x[0] for x in out], [x[1] for x in out]
            yield frame[["client", "request_id", "allowed", "retry_after"]]

    kind = dict(requests.dtypes)
    ordered = requests.select("client", "request_id", F.col("at").cast("double").alias("at")).repartition("client").sortWithinPartitions("client", "at", "request_id")
    return ordered.mapInPandas(run, f"client {kind['client']}, request_id {kind['request_id']}, allowed boolean, retry_after int")


def limited_stream(requests: DataFrame, limit: int = DEFAULT.limiter_per_minute, window: float = 60.0, late: str = "10 seconds") -> DataFrame:
    """The limiter on a stream of (client string, request_id long, at timestamp).

    Event time drives it: a client's state holds the window's hits and goes when the watermark has passed them, so a stream that is
    run to the end of its input ends, whatever the clock says.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits: list[float] = list(state.get[0]) if state.exists else []
        every = pd.concat(list(frames)).sort_values(["at", "request_id"])  # one client's requests of one micro-batch
        out, last = [], 0.0
        for at in every["at"]:
            last = at.value / 1e9
            ok, wait, hits = allow(hits, last, limit, window)
            out.append((ok, wait))
        yield pd.DataFrame({"client": key[0], "request_id": every["request_id"].to_numpy(), "allowed": [x[0] for x in out], "retry_after": [x[1] for x in out]})
        state.update((hits,))
        state.setTimeoutTimestamp(max(int((last + window) * 1000), state.getCurrentWatermarkMs() + 1))

    timed = requests.withWatermark("at", late)
    return timed.groupBy("client").applyInPandasWithState(step, "client string, request_id long, allowed boolean, retry_after int", "hits array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def breaker_states(calls: DataFrame, keys: int = DEFAULT.breaker_keys, seconds: float = DEFAULT.breaker_seconds) -> DataFrame:
    """Calls (model, call_id, key, refused, at) with `skipped` and `open`, replayed by model (ST4).

    A model is skipped for `seconds` after `keys` different keys were refused; a success clears it. A model's calls are cut where the
    state is known to be blank: a success that comes at least `seconds` after the call before it finds nothing open and leaves
    nothing refused. The stretches between are replayed apart; only finding the cuts reads a model's calls in one order.
    """
    own = W.partitionBy("model").orderBy("at", "call_id")
    blank = ~F.col("refused") & (F.col("at") - F.lag("at").over(own) >= seconds)
    timed = calls.select("model", "call_id", "key", "refused", F.col("at").cast("double").alias("at"))
    # A blank call itself is neither skipped nor opens anything: it begins the stretch behind it.
    cut = timed.withColumn("stretch", F.sum(F.coalesce(blank, F.lit(False)).cast("long")).over(own.rowsBetween(W.unboundedPreceding, 0)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, state = None, Breaker(keys, seconds)
        for frame in frames:
            out = []
            for here, key, bad, at in zip(zip(frame["model"], frame["stretch"]), frame["key"], frame["refused"], frame["at"]):
                if here != place:
                    place, state = here, Breaker(keys, seconds)
                skip = not state.available(at)
                if not skip:
                    state.refused(key, at) if bad else state.succeeded()
                out.append((skip, not state.available(at)))
            frame["skipped"], frame["open"] = [x[0] for x in out], [x[1] for x in out]
            yield frame[["model", "call_id", "skipped", "open"]]

    kind = dict(calls.dtypes)
    ordered = cut.repartition("model", "stretch").sortWithinPartitions("model", "stretch", "at", "call_id")
    return ordered.mapInPandas(run, f"model {kind['model']}, call_id {kind['call_id']}, skipped boolean, open boolean")


class Breaker:
    """One model's quota: open for a while once enough different keys were refused."""

    def __init__(self, keys: int = DEFAULT.breaker_keys, seconds: float = DEFAULT.breaker_seconds):
        self.keys, self.seconds = keys, seconds
        self.turned_away: set = set()
        self.until = float("-inf")

    def available(self, now: float) -> bool:
        return now >= self.until

    def refused(self, key, now: float) -> None:
        if self.until != float("-inf") and now >= self.until:  # what opened it has lapsed
            self.turned_away, self.until = set(), float("-inf")
        self.turned_away.add(key)
        if len(self.turned_away) >= self.keys:
            self.until = now + self.seconds

    def succeeded(self) -> None:
        self.turned_away, self.until = set(), float("-inf")


class KeyPool:
    """Keys with a sliding minute each, cool-down and disabling; the client's own state, on the driver (ST3). Repeated keys count once."""

    def __init__(self, keys: list[str], rpm: int = DEFAULT.rpm_per_key, cooldown: float = DEFAULT.cooldown_seconds):
        self.keys, self.rpm, self.cooldown = list(dict.fromkeys(keys)), rpm, cooldown
        self.hits: dict[str, list[float]] = {k: [] for k in self.keys}
        self.free_at: dict[str, float] = dict.fromkeys(self.keys, 0.0)
        self.turn = 0

    def acquire(self, now: float) -> tuple[str | None, float]:
        """(key, 0) if one is free now, else (None, seconds until one is). Earliest free first, then least used, then in turn."""
        best: tuple[Any, ...] | None = None
        for i in range(len(self.keys)):
            key = self.keys[(self.turn + i) % len(self.keys)]
            own = self.hits[key] = [h for h in self.hits[key] if now - h < 60]
            ready = max(self.free_at[key], own[0] + 60 if len(own) >= self.rpm else 0.0, now)
            if ready != float("inf") and (best is None or (ready, len(own), i) < best[:3]):
                best = ready, len(own), i, key
        if best is None:
            return None, float("inf")
        if best[0] > now:
            return None, best[0] - now
        self.hits[best[3]].append(now)
        self.turn = (self.keys.index(best[3]) + 1) % len(self.keys)
        return best[3], 0.0

    def refused(self, key: str, now: float, retry_after: float | None = None) -> None:
        """The key rests until the later of what was known and this; its minute is used up. A disabled key stays disabled."""
        self.free_at[key] = max(self.free_at[key], now + (retry_after if retry_after and retry_after > 0 else self.cooldown))
        self.hits[key] += [now] * (self.rpm - len(self.hits[key]))

    def disable(self, key: str) -> None:
        self.free_at[key] = float("inf")


def within_daily_budget(calls: DataFrame, budget: int = DEFAULT.daily_budget) -> DataFrame:
    """Calls (call_id, at as timestamp) with the number in the 24 hours up to each, and whether it is in the budget (ST5).

    A call adds one where it stands and takes it back a day later, just past the last instant at which it counts. The sum so far is
    taken within each hour, over what hours bring with them as wholes: every row is read twice, where a sliding frame reads a day's
    calls for each call. Calls without a time count each other, as peers of a null do in SQL.
    """
    wide = 3_600_000_000
    timed = calls.withColumn("_at", F.unix_micros("at")).withColumn("_hour", F.floor(F.col("_at") / wide))
    left = timed.where("_at IS NOT NULL").withColumns({"_at": F.col("_at") + (24 * wide + 1), "_hour": F.floor((F.col("_at") + (24 * wide + 1)) / wide), "_one": F.lit(-1)})
    running = F.sum("_one").over(W.partitionBy("_hour").orderBy("_at").rangeBetween(W.unboundedPreceding, 0))
    df = timed.withColumn("_one", F.lit(1)).unionByName(left).withColumn("_own", running).where("_one = 1")
    # What counts when an hour begins: the 24 hours before it, and of the hour before those the calls of its last instant, which leave in this one.
    per_hour = timed.where("_hour IS NOT NULL").groupBy("_hour").agg(F.count("*").alias("n"), F.count_if(F.pmod("_at", F.lit(wide)) == wide - 1).alias("late"))
    ahead = per_hour.select(F.explode(F.sequence(F.col("_hour") + 1, F.col("_hour") + 24)).alias("_hour"), "n").unionByName(per_hour.select((F.col("_hour") + 25).alias("_hour"), F.col("late").alias("n")))
    before = ahead.groupBy("_hour").agg(F.sum("n").alias("_before"))
    df = df.join(before, "_hour", "left").withColumn("calls_24h", F.col("_own") + F.coalesce("_before", F.lit(0))).drop("_at", "_hour", "_one", "_own", "_before")
    return df.withColumn("allowed", F.col("calls_24h") <= budget)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and means by event type and window; late events within the watermark count."""
    e = events.withWatermark("at", late) if events.isStreaming else events
    df = e.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return df.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions by user: a gap without events ends one."""
    e = events.withWatermark("at", late) if events.isStreaming else events
    df = e.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"))
    return df.select("user_id", F.col("session_window.start").alias("start"), "n")


def drained(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a streaming query over what is there, to its end, into Parquet below `path`, and read its rows.

    In `complete` mode each batch replaces the one before; otherwise batches add to each other, each written under its number.
    """
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(f"{path}/rows").select(*schema.names)


def ingest(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Process a stream of documents batch by batch: write(batch, batch_id) sees the batch's documents; the store is what was written before (ST1)."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_states(updates: DataFrame) -> DataFrame:
    """(job_id, doc_id, status, done, total, message, created_at, updated_at): jobs as their updates leave them (ST7).

    An update (job_id, seq, at, and any of the other fields, null where untouched) changes what it names: the last value of each
    field that is not null stands. On a stream of updates the same aggregation runs in `complete` mode.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return updates.groupBy("job_id").agg(*[last(c) for c in ("doc_id", "status", "done", "total", "message")], F.min("at").alias("created_at"), F.max("at").alias("updated_at"))
