"""Translations in a JSON column {locale: {field: text}}: overlay on reading, merge on writing."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Unsupported
from ..functions.expressions import COMPARISONS, Cond


class Translations:
    def __init__(self, fields: tuple[str, ...], column: str = "translations", default: str = "en-US", fallback: str | None = None):
        self.fields, self.column, self.default, self.fallback = fields, column, default, fallback

    def text(self, field: str, locale: str) -> Column:
        """The locale's text, else the fallback's, else the column itself."""
        at = lambda l: F.try_variant_get(F.try_parse_json(F.col(self.column)), f"$['{l}']['{field}']", "string")
        parts = [at(locale)] + ([at(self.fallback)] if self.fallback and self.fallback != locale else [])
        return F.coalesce(*parts, F.col(field))

    def overlay(self, df: DataFrame, locale: str) -> DataFrame:
        return df.withColumns({f: self.text(f, locale) for f in self.fields if f in df.columns}).drop(self.column)

    def where(self, field: str, locale: str, value: Any, op: str = "=") -> Cond:
        return Cond(lambda r: COMPARISONS[op](self.text(field, locale), F.lit(value)))

    def order(self, field: str, locale: str) -> Column:
        return self.text(field, locale)

    def create(self, row: dict[str, Any], locale: str, texts: dict[str, str]) -> dict[str, Any]:
        """A new row's values: its translations, and original columns where they are empty."""
        held = json.loads(row.get(self.column) or "{}")
        held.setdefault(locale, {}).update(texts)
        originals = {f: t for f, t in texts.items() if not row.get(f)}
        return {**row, **originals, self.column: json.dumps(held, ensure_ascii=False, sort_keys=True)}

    def update(self, df: DataFrame, cond: Cond, locale: str, texts: dict[str, str]) -> DataFrame:
        """Merges texts into the one row that the condition matches; the default locale's also become the originals."""
        match = F.coalesce(cond.build(F.col), F.lit(False))
        rows = df.where(match).select(self.column).take(2)
        if len(rows) != 1:
            raise Unsupported("a translation is changed in one row")
        held = json.loads(rows[0][0] or "{}")
        held.setdefault(locale, {}).update(texts)
        sets = {self.column: json.dumps(held, ensure_ascii=False, sort_keys=True)} | (texts if locale == self.default else {})
        return df.withColumns({k: F.when(match, F.lit(v)).otherwise(F.col(k)) for k, v in sets.items()})

    def remove(self, df: DataFrame, cond: Cond, locale: str) -> DataFrame:
        match = F.coalesce(cond.build(F.col), F.lit(False))
        without = F.to_json(F.map_filter(F.from_json(F.col(self.column), "map<string,map<string,string>>"), lambda k, v: k != locale))
        return df.withColumn(self.column, F.when(match, without).otherwise(F.col(self.column)))
