"""Predicates on paths of JSON text columns, by Spark's variant functions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import Cond


class Json:
    """json("props").path("a", "b").eq(3); != and every comparison leave out missing paths, as SQL does."""

    def __init__(self, name: str, *steps: str | int):
        self.name, self.steps = name, steps

    def path(self, *steps: str | int) -> Json:
        split = [s for step in steps for s in (step.split(".") if isinstance(step, str) else [step])]
        return Json(self.name, *self.steps, *split)

    @property
    def _path(self) -> str:
        return "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in self.steps)

    def _at(self, r, kind: str = "variant") -> Column:
        return F.try_variant_get(F.try_parse_json(r(self.name)), self._path, kind)

    def _typed(self, r, value: Any) -> Column:
        kind = "boolean" if isinstance(value, bool) else "long" if isinstance(value, int) else "double" if isinstance(value, float) else "string"
        return self._at(r, kind)

    def eq(self, value: Any) -> Cond:
        if value is None:
            return Cond(lambda r: F.is_variant_null(self._at(r)))
        return Cond(lambda r: self._typed(r, value) == F.lit(value))

    def ne(self, value: Any) -> Cond:
        return ~self.eq(value)

    def is_null(self) -> Cond:
        """The path is missing or holds JSON's null."""
        return Cond(lambda r: self._at(r).isNull() | F.is_variant_null(self._at(r)))

    def is_not_null(self) -> Cond:
        return ~self.is_null()

    def exists(self) -> Cond:
        """The path is there, also where it holds JSON's null."""
        return Cond(lambda r: self._at(r).isNotNull())

    def like(self, pattern: str) -> Cond:
        return Cond(lambda r: self._at(r, "string").like(pattern))

    def contains(self, value: Any) -> Cond:
        """An array at the path has the scalar; an object has all the given members."""
        if isinstance(value, dict):
            members = [Json(self.name, *self.steps, k).contains(v) if isinstance(v, dict) else Json(self.name, *self.steps, k).eq(v) for k, v in value.items()]

            def build(r):
                out = F.lit(True)
                for m in members:
                    out = out & F.coalesce(m.build(r), F.lit(False))
                return out

            return Cond(build)
        if isinstance(value, list):
            parts = [self.contains(v) for v in value]
            return Cond(lambda r: _all([p.build(r) for p in parts]))
        kind = "boolean" if isinstance(value, bool) else "bigint" if isinstance(value, int) else "double" if isinstance(value, float) else "string"
        return Cond(lambda r: F.coalesce(F.array_contains(self._at(r, f"array<{kind}>"), F.lit(value).cast(kind)), self._typed(r, value) == F.lit(value), F.lit(False)))


def _all(columns: list[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def json(name: str) -> Json:
    return Json(name)
