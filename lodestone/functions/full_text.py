"""Full-text match (all words of the query occur) and score (their share of the text's words)."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import Cond


class FullText:
    def __init__(self, *names: str):
        self.names = names

    def _tokens(self, r) -> Column:
        text = F.concat_ws(" ", *[F.coalesce(r(n), F.lit("")) for n in self.names])
        return F.filter(F.split(F.lower(text), r"\W+"), lambda t: t != "")

    @staticmethod
    def _query(query: str) -> list[str]:
        return sorted({t for t in re.split(r"\W+", query.lower(), flags=re.ASCII) if t})

    def match(self, query: str) -> Cond:
        wanted = self._query(query)
        if not wanted:
            return Cond(lambda r: F.lit(False))

        def build(r) -> Column:
            # texts without a word's letters are told apart before they are split
            text = F.lower(F.concat_ws(" ", *[F.coalesce(r(n), F.lit("")) for n in self.names]))
            likely = functools.reduce(lambda a, b: a & b, [F.contains(text, F.lit(w)) for w in wanted])
            return F.when(likely, F.size(F.array_except(F.array(*map(F.lit, wanted)), self._tokens(r))) == 0).otherwise(False)

        return Cond(build)

    def score(self, query: str) -> ScoreExpr:
        return ScoreExpr(self, self._query(query))


class ScoreExpr:
    def __init__(self, text: FullText, wanted: list[str], alias: str = "score"):
        self.text, self.wanted, self.alias = text, wanted, alias

    def as_(self, alias: str) -> ScoreExpr:
        return ScoreExpr(self.text, self.wanted, alias)

    @property
    def label(self) -> str:
        return self.alias

    def build(self, r) -> Column:
        if not self.wanted:
            return F.lit(0.0)
        tokens = self.text._tokens(r)
        return F.coalesce(F.size(F.filter(tokens, lambda t: t.isin(*self.wanted))) / F.nullif(F.size(tokens), F.lit(0)), F.lit(0.0))


def full_text(*names: str) -> FullText:
    return FullText(*names)
