"""The client of an external model: attempts, fallback, pauses and what is told of each call (ST6, SNK7)."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from factloom.functions.jsonio import closed
from factloom.streaming.stateful import Breaker, KeyPool

TELEMETRY = "purpose string, model string, key_index int, status string, attempts int, latency_ms long, in_chars long, out_chars long, error string, created_at timestamp"


@dataclass(frozen=True)
class Reply:
    """What a transport says: a text, or how it failed.

    Kinds: ok, malformed (no usable text), rate (the key's minute), quota (the model's day), rejected (the key is no good), transient
    (time-outs and overload), fatal (asking again is no use).
    """

    kind: str
    text: str = ""
    retry_after: float | None = None


class ModelCallFailed(RuntimeError):
    pass


#: What each failure asks for: a pause before the next attempt, from its number and a random share.
_PAUSES: dict[str, Callable[[int, float], float]] = {
    "malformed": lambda attempt, share: 0.5 + share,
    "transient": lambda attempt, share: min(0.5 * 2**attempt, 8.0) + share,
}


@dataclass
class Client:
    """Calls a model through `transport(model, key, prompt)`; state lives in the process that calls.

    Up to `attempts` attempts. The second half of them, and any attempt while the model's breaker is open, go to the fallback.
    """

    transport: Callable[[str, str, str], Reply]
    pool: KeyPool
    model: str
    fallback: str | None = None
    attempts: int = 6
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    chance: Callable[[], float] = random.random
    breakers: dict[str, Breaker] = field(default_factory=dict)
    calls: list[tuple] = field(default_factory=list)

    def _model(self, attempt: int, named: str) -> str:
        spare = self.fallback
        late = attempt > self.attempts // 2
        shut = not self._breaker(named).available(self.clock())
        return spare if spare and (late or shut) else named

    def _breaker(self, model: str) -> Breaker:
        return self.breakers.setdefault(model, Breaker())

    def _key(self) -> str:
        while True:
            key, wait = self.pool.acquire(self.clock())
            if key is not None:
                return key
            if wait == float("inf"):
                raise ModelCallFailed("every key is disabled")
            self.sleep(max(0.05, min(wait, 5.0)))

    def _learn(self, reply: Reply, model: str, key: str) -> None:
        now = self.clock()
        if reply.kind == "ok":
            self._breaker(model).succeeded()
        elif reply.kind == "rate":
            self.pool.refused(key, now, reply.retry_after)
        elif reply.kind == "quota":
            self._breaker(model).refused(key, now)
        elif reply.kind == "rejected":
            self.pool.disable(key)

    def ask(self, prompt: str, purpose: str, model: str | None = None) -> str:
        """The text of the first good reply; each call leaves a telemetry row, failed ones too."""
        from datetime import datetime, timezone

        named, began, reply, key, used = model or self.model, self.clock(), Reply("fatal", "not asked"), None, 0
        using = named
        while used < self.attempts and (used == 0 or reply.kind not in ("ok", "fatal")):
            used += 1
            using = self._model(used, named)
            key = self._key()
            reply = self.transport(using, key, prompt)
            if reply.kind == "ok" and not reply.text.strip():
                reply = Reply("malformed", "no text")
            self._learn(reply, using, key)
            pause = _PAUSES.get(reply.kind)
            if pause and used < self.attempts:
                self.sleep(pause(used, self.chance()))
        good = reply.kind == "ok"
        took = int(1000 * (self.clock() - began))
        place = self.pool.keys.index(key) if key in self.pool.keys else None
        self.calls.append((purpose, using, place, "ok" if good else "failed", used, took, len(prompt), len(reply.text) if good else 0, None if good else f"{reply.kind}: {reply.text}"[:500], datetime.now(timezone.utc)))
        if not good:
            raise ModelCallFailed(f"{used} attempts, the last: {reply.kind}: {reply.text[:200]}")
        return reply.text

    def ask_json(self, prompt: str, purpose: str, model: str | None = None) -> str:
        """As `ask`, the text closed where it was cut off."""
        text = self.ask(prompt, purpose, model)
        return closed(text) or text


def append_calls(spark: SparkSession, calls: list[tuple], path: str) -> None:
    """Append telemetry rows of one client to the table of calls (SNK7); a client keeps those of its own calls only."""
    if calls:
        spark.createDataFrame(calls, TELEMETRY).write.mode("append").parquet(path)


def calls_of(spark: SparkSession, path: str) -> DataFrame:
    """The table of calls, for health and the daily budget."""
    return spark.read.schema(TELEMETRY).parquet(path)
