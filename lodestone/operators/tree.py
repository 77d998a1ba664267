"""Trees as nested sets: every node spans (lft, rgt), and its descendants lie inside.

Reads are range conditions or range joins; writes change all bounds in one
pass; a rebuild numbers the nodes from their parents by sorted paths.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..errors import InvalidArgument
from ..functions.expressions import Cond
from ..plans.materialize import written as _written


def _union(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


@dataclass(frozen=True)
class Tree:
    """A table of nodes; scope: columns that tell trees of one table apart."""

    table: DataFrame
    id: str = "id"
    parent: str = "parent_id"
    lft: str = "lft"
    rgt: str = "rgt"
    depth: str = "depth"
    scope: tuple[str, ...] = ()

    def _node(self, key: Any) -> dict[str, Any]:
        row = self.table.where(F.col(self.id) == F.lit(key)).first()
        if row is None:
            raise InvalidArgument(f"no node {key}")
        return row.asDict()

    def _in_scope(self, node: dict[str, Any]) -> Column:
        out = F.lit(True)
        for s in self.scope:
            out = out & F.col(s).eqNullSafe(F.lit(node[s]))
        return out

    def _where(self, key: Any, test) -> DataFrame:
        node = self._node(key)
        return self.table.where(self._in_scope(node) & test(node)).orderBy(self.lft)

    # reads, in the order of lft

    def roots(self) -> DataFrame:
        return self.table.where(F.col(self.parent).isNull()).orderBy(self.lft)

    def leaves(self) -> DataFrame:
        return self.table.where(F.col(self.rgt) - F.col(self.lft) == 1).orderBy(self.lft)

    def flat(self) -> DataFrame:
        return self.table.orderBy(*self.scope, self.lft)

    def children(self, key: Any) -> DataFrame:
        return self._where(key, lambda n: F.col(self.parent) == F.lit(n[self.id]))

    def parent_of(self, key: Any) -> DataFrame:
        return self._where(key, lambda n: F.col(self.id) == F.lit(n[self.parent]))

    def ancestors(self, key: Any) -> DataFrame:
        return self._where(key, lambda n: (F.col(self.lft) < n[self.lft]) & (F.col(self.rgt) > n[self.rgt]))

    def descendants(self, key: Any, depth: int | None = None) -> DataFrame:
        return self._where(key, lambda n: (F.col(self.lft) > n[self.lft]) & (F.col(self.rgt) < n[self.rgt]) & (F.lit(True) if depth is None else F.col(self.depth) <= n[self.depth] + depth))

    def subtree(self, key: Any) -> DataFrame:
        return self._where(key, lambda n: F.col(self.lft).between(n[self.lft], n[self.rgt]))

    def siblings(self, key: Any) -> DataFrame:
        return self._where(key, lambda n: F.col(self.parent).eqNullSafe(F.lit(n[self.parent])) & (F.col(self.id) != n[self.id]))

    def next_sibling(self, key: Any) -> DataFrame:
        return self._where(key, lambda n: F.col(self.parent).eqNullSafe(F.lit(n[self.parent])) & (F.col(self.lft) == n[self.rgt] + 1))

    def previous_sibling(self, key: Any) -> DataFrame:
        return self._where(key, lambda n: F.col(self.parent).eqNullSafe(F.lit(n[self.parent])) & (F.col(self.rgt) == n[self.lft] - 1))

    def descendants_with_depth(self, key: Any) -> DataFrame:
        base = self._node(key)[self.depth]
        return self.descendants(key).withColumn("relative_depth", F.col(self.depth) - F.lit(base))

    def _paths(self, order: str | None = None) -> DataFrame:
        """scope columns, __id, __path (keys from the root down to the row) of all rows that a root reaches.

        Every round doubles the way that a row has gone up, so that a tree of
        depth d takes about log(d) joins.  A round that brings no row to its
        root leaves those of cycles, which have none.
        """
        key = F.struct(*[F.col(c) for c in dict.fromkeys([order or self.lft, self.id])])
        scope = list(self.scope)
        if not self.table.groupBy(self.id).count().where("count > 1").isEmpty():
            raise InvalidArgument("an identifier occurs twice")
        state = _written(self.table.select(*scope, F.col(self.id).alias("__id"), F.col(self.parent).alias("__top"), F.array(key).alias("__path")))
        every, done, before = state, [], None
        while True:
            done.append(state.where(F.col("__top").isNull()))
            open_ = state.where(F.col("__top").isNotNull())
            now = open_.count()
            if now in (0, before):
                break
            before = now
            up = every.select(*scope, F.col("__id").alias("__up"), F.col("__top").alias("__next"), F.col("__path").alias("__above"))
            state = _written(open_.drop(*scope).join(up, F.col("__top") == F.col("__up")).select(*scope, "__id", F.col("__next").alias("__top"), F.concat("__above", "__path").alias("__path")))
            every = _union([*done, state])
        return _written(_union(done)).drop("__top")

    def ancestor_pairs(self) -> DataFrame:
        """Every (ancestor, descendant) of the whole table, from the parents; work in proportion to the pairs."""
        above = self._paths(self.id).select(F.col("__id").alias("descendant_id"), F.size("__path").alias("n"), F.posexplode("__path").alias("at", "key"))
        return above.where(F.col("at") < F.col("n") - 1).select(F.col(f"key.{self.id}").alias("ancestor_id"), "descendant_id", (F.col("n") - 1 - F.col("at")).alias("distance"))

    # tests of rows

    def is_root(self) -> Column:
        return F.col(self.parent).isNull()

    def is_leaf(self) -> Column:
        return F.col(self.rgt) - F.col(self.lft) == 1

    def is_descendant(self, key: Any, of: Any) -> bool:
        n, a = self._node(key), self._node(of)
        return a[self.lft] < n[self.lft] and n[self.rgt] < a[self.rgt]

    # writes: each returns the new table

    def _shift(self, table: DataFrame, inside: Column, after: int, by: int) -> DataFrame:
        move = lambda c: F.when(inside & (F.col(c) >= after), F.col(c) + by).otherwise(F.col(c))
        return table.withColumns({self.lft: move(self.lft), self.rgt: move(self.rgt)})

    def insert(self, row: dict[str, Any], parent: Any = None, before: Any = None) -> DataFrame:
        """A new node as the last child of a parent (or last root), or before a sibling."""
        if before is not None:
            sibling = self._node(before)
            at, depth, parent_id, inside = sibling[self.lft], sibling[self.depth], sibling[self.parent], self._in_scope(sibling)
        elif parent is not None:
            node = self._node(parent)
            at, depth, parent_id, inside = node[self.rgt], node[self.depth] + 1, node[self.id], self._in_scope(node)
        else:
            inside = self._in_scope({s: row.get(s) for s in self.scope})
            at, depth, parent_id = self.table.where(inside).agg(F.coalesce(F.max(self.rgt), F.lit(0)).alias("m")).first()["m"] + 1, 0, None
        own = {**row, self.lft: at, self.rgt: at + 1, self.depth: depth, self.parent: parent_id}
        fresh = self.table.sparkSession.createDataFrame([tuple(own.get(c) for c in self.table.columns)], self.table.schema)
        return self._shift(self.table, inside, at, 2).unionByName(fresh)

    def remove(self, key: Any) -> DataFrame:
        """Takes a node and all below it away and closes the gap."""
        n = self._node(key)
        width = n[self.rgt] - n[self.lft] + 1
        gone = self._in_scope(n) & F.col(self.lft).between(n[self.lft], n[self.rgt])
        return self._shift(self.table.where(~gone), self._in_scope(n), n[self.rgt] + 1, -width)

    def move(self, key: Any, parent: Any = None) -> DataFrame:
        """Makes a node, with all below it, the last child of another (or the last root)."""
        n = self._node(key)
        if parent is not None:
            target = self._node(parent)
            if n[self.lft] <= target[self.lft] <= n[self.rgt]:
                raise InvalidArgument("a node can't go below itself")
            at, depth = target[self.rgt], target[self.depth] + 1
        else:
            at, depth = self.table.where(self._in_scope(n)).agg(F.max(self.rgt).alias("m")).first()["m"] + 1, 0
        low, high = n[self.lft], n[self.rgt]
        width = high - low + 1
        to = at - width if at > high else at

        def bound(c: str) -> Column:
            x = F.col(c)
            inside = F.col(self.lft).between(low, high)
            closed = F.when(x > high, x - width).otherwise(x)  # as if the node were gone
            return F.when(self._in_scope(n), F.when(inside, x + (to - low)).otherwise(F.when(closed >= to, closed + width).otherwise(closed))).otherwise(x)

        mine = self._in_scope(n) & F.col(self.lft).between(low, high)
        return self.table.withColumns({
            self.depth: F.when(mine, F.col(self.depth) + (depth - n[self.depth])).otherwise(F.col(self.depth)),
            self.parent: F.when(F.col(self.id) == F.lit(key), F.lit(parent).cast(self.table.schema[self.parent].dataType)).otherwise(F.col(self.parent)),
            self.lft: bound(self.lft),
            self.rgt: bound(self.rgt),
        })

    def check(self) -> dict[str, int]:
        """Numbers of faults: bounds out of order, bounds used twice or missing, children outside their parent, wrong depths."""
        scope = list(self.scope)
        bounds = self.table.select(*scope, F.explode(F.array(self.lft, self.rgt)).alias("b"))
        per = bounds.groupBy(*scope).agg(F.count("*").alias("n"), F.countDistinct("b").alias("d"), F.min("b").alias("low"), F.max("b").alias("high"))
        p = self.table.select(*[F.col(s).alias(f"__{s}") for s in scope], F.col(self.id).alias("__id"), F.col(self.lft).alias("__l"), F.col(self.rgt).alias("__r"), F.col(self.depth).alias("__d"))
        joined = self.table.join(p, F.col(self.parent) == F.col("__id"), "left")
        has = F.col(self.parent).isNotNull()
        outside = has & (F.col("__id").isNull() | (F.col(self.lft) <= F.col("__l")) | (F.col(self.rgt) >= F.col("__r")))
        depth = F.when(has, F.col(self.depth) != F.col("__d") + 1).otherwise(F.col(self.depth) != 0)
        n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
        a = joined.agg(n(F.col(self.lft) >= F.col(self.rgt)).alias("order"), n(outside).alias("parent"), n(F.coalesce(depth, F.lit(True))).alias("depth")).first().asDict()
        b = per.agg(F.coalesce(F.sum(F.col("n") - F.col("d")), F.lit(0)).alias("repeated"), F.coalesce(F.sum(F.col("high") - F.col("low") + 1 - F.col("d")), F.lit(0)).alias("missing")).first().asDict()
        return {**a, **b}

    def rebuild(self, order: str | None = None) -> DataFrame:
        """Bounds and depths from the parents alone: paths sorted and numbered over range partitions.

        Rows that no root reaches (orphans, cycles and what is below them) stay as they are.
        """
        spark, scope = self.table.sparkSession, list(self.scope)
        paths = self._paths(order)
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        sort = [*scope, "__path"]
        placed = _written(paths.repartitionByRange(parts, *sort).withColumn("__part", F.spark_partition_id()))
        # the rows of earlier partitions, of which there are few per scope
        counts = placed.groupBy(*scope, "__part").agg(F.count("*").alias("__many"))
        before = F.coalesce(F.sum("__many").over(W.partitionBy(*scope).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        offsets = counts.withColumn("__before", before).select(*[F.col(c).alias(f"__o_{c}") for c in scope], F.col("__part").alias("__p"), "__before")
        inside = placed.withColumn("__in", F.row_number().over(W.partitionBy("__part", *scope).orderBy("__path")))
        same = F.col("__part") == F.col("__p")
        for c in scope:
            same = same & F.col(c).eqNullSafe(F.col(f"__o_{c}"))
        numbered = inside.join(offsets, same).select("__id", "__path", (F.col("__before") + F.col("__in")).alias("__n"), (F.size("__path") - 1).alias("__depth"))
        # below(n): rows whose path holds n
        sizes = placed.select(F.explode(F.transform("__path", lambda k: k[self.id])).alias("__id")).groupBy("__id").agg(F.count("*").alias("__size"))
        lft = 2 * F.col("__n") - 1 - F.col("__depth")
        done = numbered.join(sizes, "__id").select(F.col("__id"), lft.alias("__lft"), (lft + 2 * F.col("__size") - 1).alias("__rgt"), "__depth")
        types = {f.name: f.dataType for f in self.table.schema.fields}
        fresh = {self.lft: "__lft", self.rgt: "__rgt", self.depth: "__depth"}
        value = lambda c: F.when(F.col("__id").isNotNull(), F.col(fresh[c]).cast(types[c])).otherwise(F.col(c)) if c in fresh else F.col(c)
        return self.table.join(done, F.col(self.id) == F.col("__id"), "left").select(*[value(c).alias(c) for c in self.table.columns])

    def nested(self, key: Any = None) -> list[dict[str, Any]]:
        """Nested dicts (children) of a subtree or of all, on the driver."""
        rows = (self.subtree(key) if key is not None else self.flat()).collect()
        out: list[dict[str, Any]] = []
        stack: list[dict[str, Any]] = []
        for row in rows:
            node = {**row.asDict(), "children": []}
            while stack and (stack[-1][self.rgt] < node[self.lft] or any(stack[-1][s] != node[s] for s in self.scope)):
                stack.pop()
            (stack[-1]["children"] if stack else out).append(node)
            stack.append(node)
        return out


@dataclass(frozen=True)
class Verbs:
    """Conditions and orders of trees for any query: query.scope(verbs.descendants_of(node)).

    A node is a row (or dict) with its bounds, depth and scope columns; names are
    the query's fields.
    """

    id: str = "id"
    parent: str = "parent_id"
    lft: str = "lft"
    rgt: str = "rgt"
    depth: str = "depth"
    scope: tuple[str, ...] = ()

    def _verb(self, test):
        return lambda query: query.where(Cond(test))

    def _near(self, node: Any, test):
        node = node.asDict() if hasattr(node, "asDict") else node

        def build(r):
            out = test(r, node)
            for s in self.scope:
                out = out & r(s).eqNullSafe(F.lit(node[s]))
            return out

        return self._verb(build)

    def in_scope(self, **values: Any):
        return self._verb(lambda r: functools.reduce(lambda a, b: a & b, [r(k).eqNullSafe(F.lit(v)) for k, v in values.items()], F.lit(True)))

    def roots(self):
        return self._verb(lambda r: r(self.parent).isNull())

    def leaves(self):
        return self._verb(lambda r: r(self.rgt) - r(self.lft) == 1)

    def at_depth(self, depth: int):
        return self._verb(lambda r: r(self.depth) == depth)

    def at_least_depth(self, depth: int):
        return self._verb(lambda r: r(self.depth) >= depth)

    def at_most_depth(self, depth: int):
        return self._verb(lambda r: r(self.depth) <= depth)

    def ancestors_of(self, node: Any, itself: bool = False):
        if itself:
            return self._near(node, lambda r, n: (r(self.lft) <= n[self.lft]) & (r(self.rgt) >= n[self.rgt]))
        return self._near(node, lambda r, n: (r(self.lft) < n[self.lft]) & (r(self.rgt) > n[self.rgt]))

    def descendants_of(self, node: Any, itself: bool = False, within: int | None = None, at: int | None = None):
        """within: levels below the node at most; at: exactly."""

        def test(r, n):
            out = (r(self.lft) >= n[self.lft]) & (r(self.rgt) <= n[self.rgt]) if itself else (r(self.lft) > n[self.lft]) & (r(self.rgt) < n[self.rgt])
            if within is not None:
                out = out & (r(self.depth) <= n[self.depth] + within)
            return out & (r(self.depth) == n[self.depth] + at) if at is not None else out

        return self._near(node, test)

    def children_of(self, node: Any):
        return self._near(node, lambda r, n: r(self.parent) == F.lit(n[self.id]))

    def siblings_of(self, node: Any, itself: bool = False):
        return self._near(node, lambda r, n: r(self.parent).eqNullSafe(F.lit(n[self.parent])) & (F.lit(itself) | (r(self.id) != F.lit(n[self.id]))))

    def in_order(self):
        return lambda query: query.order_by(*self.scope, self.lft)

    def reversed(self):
        return lambda query: query.order_by_desc(*self.scope, self.lft)
