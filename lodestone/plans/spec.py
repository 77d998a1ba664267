"""What a query asks for, as plain data; verbs make changed copies."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Join:
    kind: str
    source: Any  # table name, query or DataFrame
    alias: str | None
    on: tuple[tuple[str, Any], ...] = ()


@dataclass(frozen=True)
class RelationAgg:
    fn: str
    relation: str
    field: str | None
    alias: str
    child: Any  # changes the child query, or None


@dataclass(frozen=True)
class Spec:
    alias: str | None = None
    where: tuple[tuple[str, Any], ...] = ()
    joins: tuple[Join, ...] = ()
    select: tuple[Any, ...] = ()
    hidden: tuple[str, ...] = ()
    group: tuple[str, ...] = ()
    having: tuple[Any, ...] = ()
    order: tuple[tuple[Any, bool], ...] = ()  # name or expression, descending
    limit: int | None = None
    offset: int | None = None
    deleted: str = "without"  # without, with, only
    loads: tuple[tuple[str, Any, int | None], ...] = ()  # relation, child, rows per parent
    aggs: tuple[RelationAgg, ...] = ()
    shard: Any = None
    all_shards: bool = False
    plugins: tuple[Any, ...] = ()
    skip_hooks: bool = False
    skip_events: bool = False
    cache_ttl: float | None = None
    cache_key: str | None = None
    cache_tags: tuple[str, ...] = ()
    timeout: float | None = None

    def but(self, **changes: Any) -> Spec:
        return replace(self, **changes)
