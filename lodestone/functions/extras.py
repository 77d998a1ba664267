"""Session services around queries: result cache, events, timeouts, metrics, serialization."""

from __future__ import annotations

import hashlib
import threading
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession

from ..errors import RelationNotLoaded
from ..schema import Model


class Cache:
    """Collected rows by key, for a time; tags forget several at once.  Writes forget nothing by themselves.

    Entries whose time has passed go when another one comes, and the oldest ones beyond `most`.
    """

    def __init__(self, clock: Callable[[], float] = time.monotonic, most: int = 1000):
        self.clock, self.most, self.entries = clock, most, {}

    def has(self, key: str) -> bool:
        found = self.entries.get(key)
        return bool(found) and found[0] > self.clock()

    def remember(self, key: str, ttl: float, tags: tuple[str, ...], make: Callable[[], Any]) -> Any:
        found = self.entries.get(key)
        if found and found[0] > self.clock():
            return found[2]
        value = make()
        now = self.clock()
        self.entries = {k: e for k, e in self.entries.items() if e[0] > now and k != key}
        self.entries[key] = (now + ttl, set(tags), value)
        while len(self.entries) > self.most:
            self.entries.pop(next(iter(self.entries)))
        return value

    def forget(self, key: str) -> None:
        self.entries.pop(key, None)

    def forget_tags(self, *tags: str) -> None:
        self.entries = {k: e for k, e in self.entries.items() if not e[1] & set(tags)}

    def clear(self) -> None:
        self.entries.clear()


def plan_key(df: DataFrame, tenant: dict[str, Any]) -> str:
    """A key from the plan (without expression numbers) and the tenant."""
    return hashlib.sha256(f"{df.semanticHash()}|{df.columns}|{sorted(tenant.items())}".encode()).hexdigest()


# The names of the events that handlers can be set on.
EVENTS = (
    "before_create", "after_create", "before_update", "after_update", "before_delete", "after_delete", "before_restore", "after_restore",
    "after_find", "before_sql", "after_sql", "after_cache_hit", "after_cache_miss", "after_commit", "after_rollback",
)


class Events:
    """Handlers by name: those of EVENTS, and "query" and "write" for every read and every write."""

    def __init__(self) -> None:
        self.handlers: dict[str, list[Callable[[dict], None]]] = {}

    def on(self, name: str, handler: Callable[[dict], None]) -> Callable[[], None]:
        self.handlers.setdefault(name, []).append(handler)
        return lambda: self.handlers[name].remove(handler)

    def has(self, name: str) -> bool:
        return bool(self.handlers.get(name))

    def emit(self, name: str, payload: dict[str, Any]) -> None:
        for h in list(self.handlers.get(name, [])):
            h(payload)


class MemoryRecorder:
    """Keeps the samples of events; record(name, payload) is all a recorder needs."""

    def __init__(self) -> None:
        self.samples: list[tuple[str, dict]] = []

    def record(self, name: str, payload: dict) -> None:
        self.samples.append((name, payload))


def measure(events: Events, recorder: Any, names: tuple[str, ...] = ("query", "write")) -> list[Callable[[], None]]:
    return [events.on(n, lambda p, n=n: recorder.record(n, p)) for n in names]


def with_timeout(spark: SparkSession, run: Callable[[], Any], seconds: float | None) -> Any:
    """Runs an action; its jobs are cancelled after so many seconds."""
    if seconds is None:
        return run()
    context, tag = spark.sparkContext, f"timeout-{threading.get_ident()}-{time.monotonic_ns()}"
    timer = threading.Timer(seconds, lambda: context.cancelJobsWithTag(tag))
    context.addJobTag(tag)
    timer.start()
    try:
        return run()
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def serialize(value: Any, model: Model | None = None, only: tuple[str, ...] = (), omit: tuple[str, ...] = (), registry: Any = None) -> Any:
    """Rows as plain dicts, nested relations included; hidden columns are left out, with a registry those of nested models too."""
    if isinstance(value, Row):
        value = value.asDict()
    if isinstance(value, dict):
        hidden = model.hidden_columns if model else set()
        target = lambda k: registry.models.get(model.relations[k].target) if registry and model and k in model.relations else None
        return {k: serialize(v, target(k), registry=registry) for k, v in value.items() if k not in hidden and k not in omit and (not only or k in only)}
    if isinstance(value, (list, tuple)):
        return [serialize(v, model, only, omit, registry) for v in value]
    return value


def loaded(row: Row | dict, relation: str) -> Any:
    """A relation that was loaded with the row: a row, a list or None; an error where it wasn't asked for."""
    values = row.asDict() if isinstance(row, Row) else row
    if relation not in values:
        raise RelationNotLoaded(f"{relation} wasn't loaded")
    return values[relation]
