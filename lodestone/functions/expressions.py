"""Conditions and expressions that build Spark columns.

A condition knows nothing of tables: `build` gets a function that turns names
into columns.  Values may be literals, columns, raw SQL or queries (scalar
subqueries).  Logic is SQL's three-valued logic.
"""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument

Resolve = Callable[[str], Column]

COMPARISONS: dict[str, Callable[[Column, Any], Column]] = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
PATTERNS: dict[str, Callable[[Column, Any], Column]] = {
    "like": lambda a, b: a.like(b),
    "not like": lambda a, b: ~a.like(b),
    "ilike": lambda a, b: a.ilike(b),
    "not ilike": lambda a, b: ~a.ilike(b),
}


def sql_literal(value: Any) -> str:
    """A Python value as SQL text, for the arguments of raw SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float, decimal.Decimal)):
        return str(value) if not isinstance(value, float) else f"{value!r}D"
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP{'_NTZ' if value.tzinfo is None else ''} '{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, (list, tuple)):
        return ", ".join(sql_literal(v) for v in value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def bind(sql: str, args: tuple[Any, ...]) -> str:
    """Puts arguments for the question marks outside of quotes."""
    out, rest, quote = [], list(args), ""
    for ch in sql:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"`":
            quote = ch
        elif ch == "?":
            if not rest:
                raise InvalidArgument("too few arguments")
            out.append(sql_literal(rest.pop(0)))
            continue
        out.append(ch)
    if rest:
        raise InvalidArgument("too many arguments")
    return "".join(out)


class Raw:
    """SQL text with ? arguments, as a condition, a select item or an order."""

    def __init__(self, sql: str, *args: Any):
        self.sql, self.args, self.name = sql, args, None

    def as_(self, name: str) -> Raw:
        out = Raw(self.sql, *self.args)
        out.name = name
        return out

    def build(self, resolve: Resolve) -> Column:
        return F.expr(bind(self.sql, self.args))


def value_of(value: Any, resolve: Resolve) -> Any:
    if isinstance(value, (Raw, Increment)):
        return value.build(resolve)
    if hasattr(value, "scalar_column"):
        return value.scalar_column()
    if isinstance(value, DataFrame):
        return value.scalar()
    if isinstance(value, Column):
        return value
    return F.lit(value)


class Cond:
    def __init__(self, build: Callable[[Resolve], Column]):
        self.build = build

    def __and__(self, other: Cond) -> Cond:
        return Cond(lambda r: self.build(r) & other.build(r))

    def __or__(self, other: Cond) -> Cond:
        return Cond(lambda r: self.build(r) | other.build(r))

    def __invert__(self) -> Cond:
        return Cond(lambda r: ~self.build(r))


def all_of(*conds: Cond) -> Cond:
    return fold([("and", c) for c in conds])


def any_of(*conds: Cond) -> Cond:
    return fold([("or", c) for c in conds])


def not_(cond: Cond) -> Cond:
    return ~cond


def fold(parts: list[tuple[str, Any]]) -> Cond | None:
    """A flat list of AND and OR parts with SQL's precedence: AND binds tighter."""
    groups: list[list[Any]] = []
    for joiner, cond in parts:
        if joiner == "or" or not groups:
            groups.append([])
        groups[-1].append(cond)
    if not groups:
        return None

    def build(resolve: Resolve) -> Column:
        out = None
        for group in groups:
            own = group[0].build(resolve)
            for c in group[1:]:
                own = own & c.build(resolve)
            out = own if out is None else out | own
        return out

    return Cond(build)


def compare(name: str, op: str, value: Any) -> Cond:
    op = op.lower().strip()
    if op in COMPARISONS:
        return Cond(lambda r: COMPARISONS[op](r(name), value_of(value, r)))
    if op in PATTERNS:
        return Cond(lambda r: PATTERNS[op](r(name), value))
    if op in ("is", "is not") and value is None:
        return Cond(lambda r: r(name).isNull() if op == "is" else r(name).isNotNull())
    raise InvalidArgument(f"no operator {op}")


def compare_columns(left: str, op: str, right: str) -> Cond:
    if op not in COMPARISONS:
        raise InvalidArgument(f"no operator {op} between columns")
    return Cond(lambda r: COMPARISONS[op](r(left), r(right)))


def condition(args: tuple[Any, ...]) -> Any:
    """(condition), (name, value) or (name, operator, value)."""
    if len(args) == 1 and hasattr(args[0], "build"):
        return args[0]
    if len(args) == 2:
        return compare(args[0], "=", args[1])
    if len(args) == 3:
        return compare(*args)
    raise InvalidArgument("a condition is (condition), (name, value) or (name, operator, value)")


def in_query(column: Column, query: Any) -> Column:
    frame = query if isinstance(query, DataFrame) else query.df()
    if len(frame.columns) != 1:
        raise InvalidArgument("IN needs a query of one column")
    return column.isin(frame)


def exists(query: Any) -> Cond:
    frame = (lambda: query) if isinstance(query, DataFrame) else query.df
    return Cond(lambda r: frame().exists())


def outer(name: str) -> Column:
    """A column of the surrounding query, inside a subquery."""
    return F.col(name).outer()


class Name:
    """A named column, to build conditions from: col("x").gt(3)."""

    def __init__(self, name: str, alias: str | None = None):
        self.name, self.alias = name, alias

    def as_(self, alias: str) -> Name:
        return Name(self.name, alias)

    def build(self, resolve: Resolve) -> Column:
        return resolve(self.name)

    def _op(self, op: str, value: Any) -> Cond:
        return compare(self.name, op, value)

    def eq(self, v: Any) -> Cond:
        return self._op("=", v)

    def ne(self, v: Any) -> Cond:
        return self._op("!=", v)

    def gt(self, v: Any) -> Cond:
        return self._op(">", v)

    def gte(self, v: Any) -> Cond:
        return self._op(">=", v)

    def lt(self, v: Any) -> Cond:
        return self._op("<", v)

    def lte(self, v: Any) -> Cond:
        return self._op("<=", v)

    def like(self, v: str) -> Cond:
        return self._op("like", v)

    def not_like(self, v: str) -> Cond:
        return self._op("not like", v)

    def ilike(self, v: str) -> Cond:
        return self._op("ilike", v)

    def not_ilike(self, v: str) -> Cond:
        return self._op("not ilike", v)

    def contains(self, v: str) -> Cond:
        return Cond(lambda r: r(self.name).contains(v))

    def starts_with(self, v: str) -> Cond:
        return Cond(lambda r: r(self.name).startswith(v))

    def ends_with(self, v: str) -> Cond:
        return Cond(lambda r: r(self.name).endswith(v))

    def in_(self, *values: Any) -> Cond:
        if len(values) == 1 and (isinstance(values[0], DataFrame) or hasattr(values[0], "scalar_column")):
            return Cond(lambda r: in_query(r(self.name), values[0]))
        values = tuple(values[0]) if len(values) == 1 and isinstance(values[0], (list, tuple, set)) else values
        return Cond(lambda r: r(self.name).isin(*values) if values else F.lit(False))

    def not_in(self, *values: Any) -> Cond:
        inside = self.in_(*values)
        return Cond(lambda r: ~inside.build(r))

    def between(self, low: Any, high: Any) -> Cond:
        return Cond(lambda r: r(self.name).between(value_of(low, r), value_of(high, r)))

    def not_between(self, low: Any, high: Any) -> Cond:
        return ~self.between(low, high)

    def is_null(self) -> Cond:
        return Cond(lambda r: r(self.name).isNull())

    def is_not_null(self) -> Cond:
        return Cond(lambda r: r(self.name).isNotNull())

    def compare_to(self, op: str, other: str) -> Cond:
        return compare_columns(self.name, op, other)

    def eq_col(self, other: str) -> Cond:
        return self.compare_to("=", other)

    def ne_col(self, other: str) -> Cond:
        return self.compare_to("!=", other)

    def gt_col(self, other: str) -> Cond:
        return self.compare_to(">", other)

    def gte_col(self, other: str) -> Cond:
        return self.compare_to(">=", other)

    def lt_col(self, other: str) -> Cond:
        return self.compare_to("<", other)

    def lte_col(self, other: str) -> Cond:
        return self.compare_to("<=", other)


def col(name: str) -> Name:
    return Name(name)


class Increment:
    """A change of a column by a number, for updates."""

    def __init__(self, by: Any, name: str | None = None):
        self.by, self.name = by, name

    def build(self, resolve: Resolve) -> Column:
        return resolve(self.name) + F.lit(self.by)


def increment(by: Any = 1) -> Increment:
    return Increment(by)


def decrement(by: Any = 1) -> Increment:
    return Increment(-by)


class Agg:
    """count, sum, avg, min or max of a column (count of "*": of rows)."""

    def __init__(self, fn: str, name: str, alias: str | None = None):
        self.fn, self.name, self.alias = fn, name, alias

    def as_(self, alias: str) -> Agg:
        return Agg(self.fn, self.name, alias)

    @property
    def label(self) -> str:
        return self.alias or (self.fn if self.name == "*" else f"{self.fn}_{self.name.rpartition('.')[2]}")

    def build(self, resolve: Resolve) -> Column:
        if self.fn == "count":
            return F.count(F.lit(1) if self.name == "*" else resolve(self.name))
        return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[self.fn](resolve(self.name))


def count(name: str = "*") -> Agg:
    return Agg("count", name)


def sum_(name: str) -> Agg:
    return Agg("sum", name)


def avg(name: str) -> Agg:
    return Agg("avg", name)


def min_(name: str) -> Agg:
    return Agg("min", name)


def max_(name: str) -> Agg:
    return Agg("max", name)


def escape_like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
