"""Models: typed field lists with flags, and the relations between them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from .errors import InvalidArgument, UnknownField, UnknownRelation


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


@dataclass(frozen=True)
class Field:
    name: str
    type: T.DataType
    column: str
    logical: str
    nullable: bool = True
    primary: bool = False
    hidden: bool = False
    virtual: bool = False
    ignored: bool = False
    optimistic: bool = False
    soft_delete: bool = False
    auto_create: bool = False
    auto_update: bool = False
    unique: bool = False
    index: bool = False
    full_text: bool = False
    enum: tuple[str, ...] = ()
    default: Any = None
    size: int | None = None
    comment: str = ""

    @property
    def stored(self) -> bool:
        return not (self.virtual or self.ignored)


def _decimal(precision: int = 38, scale: int = 18) -> T.DataType:
    if not 0 < precision <= 38 or not 0 <= scale <= precision:
        raise InvalidArgument(f"decimal({precision}, {scale})")
    return T.DecimalType(precision, scale)


_POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
#: Logical type names and how Spark stores them.
TYPES: dict[str, T.DataType] = {
    "string": T.StringType(), "text": T.StringType(), "bool": T.BooleanType(), "int": T.IntegerType(), "bigint": T.LongType(), "uint": T.LongType(),
    "ubigint": T.DecimalType(20, 0), "float": T.FloatType(), "double": T.DoubleType(), "binary": T.BinaryType(), "json": T.StringType(), "uuid": T.StringType(),
    "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(), "date": T.DateType(), "time": T.StringType(), "enum": T.StringType(), "email": T.StringType(),
    "url": T.StringType(), "ip": T.StringType(), "mac": T.StringType(), "phone": T.StringType(), "slug": T.StringType(), "color": T.StringType(),
    "string_array": T.ArrayType(T.StringType()), "int_array": T.ArrayType(T.LongType()), "point": _POINT,
}


@dataclass(frozen=True)
class Relation:
    """An edge between models.

    kind: belongs_to, has_one, has_many, many_to_many, or one of these with
    dynamic_ before it, where a type column tells the other side's model.
    """

    name: str
    kind: str
    target: str | None = None
    local: str | None = None  # column on this side
    foreign: str | None = None  # column on the other side
    through: str | None = None  # link table
    through_local: str | None = None
    through_foreign: str | None = None
    type_column: str | None = None
    type_value: str | None = None
    types: dict[str, str] = field(default_factory=dict)  # type value -> model
    order: tuple[str, ...] = ()

    @property
    def many(self) -> bool:
        return self.kind.endswith(("has_many", "many_to_many"))


class Model:
    """Built fluently; checked when it is registered."""

    def __init__(self, table: str, *, connection: str | None = None):
        self.table, self.connection = table, connection
        self.fields: dict[str, Field] = {}
        self.relations: dict[str, Relation] = {}
        self.tenant: tuple[str, ...] = ()
        self.shard: Any = None
        self.hooks: dict[str, list] = {}

    def field(self, name: str, type_: str, *, column: str | None = None, precision: int = 38, scale: int = 18, **flags: Any) -> Model:
        if name in self.fields:
            raise InvalidArgument(f"field {name} is there twice")
        kind = _decimal(precision, scale) if type_ == "decimal" else TYPES.get(type_)
        if kind is None:
            raise InvalidArgument(f"no type {type_}")
        size = flags.get("size")
        if size is not None and size <= 0:
            raise InvalidArgument(f"size of {name}")
        own = Field(name, kind, column or snake(name), type_, **flags)
        if own.column in {f.column for f in self.fields.values()}:
            raise InvalidArgument(f"column {own.column} is there twice")
        if own.optimistic and not isinstance(kind, (T.IntegerType, T.LongType)):
            raise InvalidArgument(f"{name}: a version must be an integer")
        if own.soft_delete and not isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            raise InvalidArgument(f"{name}: a deletion mark must be a time")
        if own.enum and own.default is not None and own.default not in own.enum:
            raise InvalidArgument(f"{name}: the default isn't one of the values")
        self.fields[name] = replace(own, index=True) if own.soft_delete else own
        return self

    def base(self) -> Model:
        """id, created_at and updated_at."""
        return self.field("id", "bigint", primary=True, nullable=False).field("created_at", "timestamp", auto_create=True).field("updated_at", "timestamp", auto_create=True, auto_update=True)

    def by_tenant(self, *fields: str) -> Model:
        self.tenant = fields
        return self

    def sharded(self, strategy: Any) -> Model:
        self.shard = strategy
        return self

    def on(self, hook: str, fn: Any) -> Model:
        self.hooks.setdefault(hook, []).append(fn)
        return self

    def _relate(self, relation: Relation) -> Model:
        if relation.name in self.relations:
            raise InvalidArgument(f"relation {relation.name} is there twice")
        self.relations[relation.name] = relation
        return self

    def belongs_to(self, name: str, target: str, local: str, foreign: str) -> Model:
        return self._relate(Relation(name, "belongs_to", target, local, foreign))

    def has_one(self, name: str, target: str, local: str, foreign: str, order: tuple[str, ...] = ()) -> Model:
        return self._relate(Relation(name, "has_one", target, local, foreign, order=order))

    def has_many(self, name: str, target: str, local: str, foreign: str, order: tuple[str, ...] = ()) -> Model:
        return self._relate(Relation(name, "has_many", target, local, foreign, order=order))

    def many_to_many(self, name: str, target: str, local: str, through: str, through_local: str, through_foreign: str, foreign: str, order: tuple[str, ...] = ()) -> Model:
        return self._relate(Relation(name, "many_to_many", target, local, foreign, through, through_local, through_foreign, order=order))

    def dynamic_belongs_to(self, name: str, local: str, type_column: str, types: dict[str, str], foreign: str) -> Model:
        return self._relate(Relation(name, "dynamic_belongs_to", None, local, foreign, type_column=type_column, types=dict(types)))

    def dynamic_has_many(self, name: str, target: str, local: str, foreign: str, type_column: str, type_value: str, order: tuple[str, ...] = ()) -> Model:
        return self._relate(Relation(name, "dynamic_has_many", target, local, foreign, type_column=type_column, type_value=type_value, order=order))

    def dynamic_many_to_many(self, name: str, target: str, local: str, through: str, through_local: str, through_foreign: str, foreign: str, type_column: str, type_value: str, order: tuple[str, ...] = ()) -> Model:
        return self._relate(Relation(name, "dynamic_many_to_many", target, local, foreign, through, through_local, through_foreign, type_column, type_value, order=order))

    # reading the model

    def column(self, name: str) -> str:
        """A field's or column's column name."""
        if name in self.fields:
            return self.fields[name].column
        if any(f.column == name for f in self.fields.values()):
            return name
        raise UnknownField(f"{self.table} has no field {name}")

    def by_column(self, column: str) -> Field | None:
        return next((f for f in self.fields.values() if f.column == column), None)

    def relation(self, name: str) -> Relation:
        if name not in self.relations:
            raise UnknownRelation(f"{self.table} has no relation {name}")
        return self.relations[name]

    def _one(self, flag: str) -> str | None:
        found = [f.column for f in self.fields.values() if getattr(f, flag)]
        return found[0] if len(found) == 1 else None

    @property
    def primary(self) -> str | None:
        return self._one("primary")

    @property
    def deleted(self) -> str | None:
        return self._one("soft_delete")

    @property
    def version(self) -> str | None:
        return self._one("optimistic")

    @property
    def default_columns(self) -> list[str]:
        return [f.column for f in self.fields.values() if f.stored and not f.hidden]

    @property
    def hidden_columns(self) -> set[str]:
        return {f.column for f in self.fields.values() if f.hidden}

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.column, f.type, f.nullable, {"logical": f.logical}) for f in self.fields.values() if f.stored])


class Registry:
    def __init__(self) -> None:
        self.models: dict[str, Model] = {}

    def register(self, *models: Model) -> None:
        for m in models:
            self.models[m.table] = m
        for m in models:
            for r in m.relations.values():
                m.column(r.local)
                targets = list(r.types.values()) if r.kind == "dynamic_belongs_to" else [r.target]
                for t in targets:
                    if t not in self.models:
                        raise UnknownRelation(f"{m.table}.{r.name}: {t} isn't registered")
                    self.models[t].column(r.foreign)
