"""Errors, each with a kind that callers can test."""

from __future__ import annotations


class LodestoneError(Exception):
    kind = "error"


class InvalidArgument(LodestoneError):
    kind = "invalid_argument"


class InvalidQuery(LodestoneError):
    kind = "invalid_query"


class UnknownField(InvalidArgument):
    kind = "unknown_field"


class HiddenField(InvalidArgument):
    kind = "hidden_field"


class UnknownConnection(LodestoneError):
    kind = "unknown_connection"


class UnknownRelation(LodestoneError):
    kind = "unknown_relation"


class OrderRequired(InvalidQuery):
    kind = "order_required"


class UnsafeWrite(LodestoneError):
    """An update or delete without a condition."""

    kind = "unsafe_write"


class StaleData(LodestoneError):
    kind = "stale_data"


class TenantRequired(LodestoneError):
    kind = "tenant_required"


class Unsupported(LodestoneError):
    kind = "unsupported"


class UnsafeSchemaChange(LodestoneError):
    kind = "unsafe_schema_change"


class ShardMismatch(LodestoneError):
    kind = "shard_mismatch"


class WriteConflict(LodestoneError):
    """Another writer committed since this one began; it may try again."""

    kind = "write_conflict"


class TenantMismatch(LodestoneError):
    """A key belongs to another tenant."""

    kind = "tenant_mismatch"


class RelationNotLoaded(LodestoneError):
    kind = "relation_not_loaded"
