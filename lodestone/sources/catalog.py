"""Named connections and tables: Parquet folders, JDBC databases, catalog tables, DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..errors import UnknownConnection


@dataclass(frozen=True)
class Split:
    """How a JDBC table is read in parts: ranges of a numeric, date or time column."""

    column: str
    lower: object
    upper: object
    parts: int


@dataclass
class Connection:
    """Where a connection's tables are.

    kind: parquet (a folder with <table>.parquet each), jdbc (options url,
    driver, ...), catalog (the session's own tables).

    A JDBC table is read by one task unless splits or predicates name it:
    splits give a column and its bounds (rows beyond them go to the first and
    last part), predicates one SQL condition for each part.  Filters, columns
    and limits of queries are pushed down to the database.
    """

    kind: str = "parquet"
    path: str = ""
    options: dict[str, str] = field(default_factory=dict)
    splits: dict[str, Split] = field(default_factory=dict)
    predicates: dict[str, list[str]] = field(default_factory=dict)

    def jdbc_options(self, table: str) -> dict[str, str]:
        split = self.splits.get(table)
        by = {"partitionColumn": split.column, "lowerBound": str(split.lower), "upperBound": str(split.upper), "numPartitions": str(split.parts)} if split else {}
        return {"fetchsize": "10000", "pushDownAggregate": "true", "pushDownLimit": "true", **self.options, **by}

    def load(self, spark: SparkSession, table: str) -> DataFrame:
        if self.kind == "parquet":
            return spark.read.parquet(f"{self.path}/{table}.parquet")
        if self.kind == "jdbc":
            options = self.jdbc_options(table)
            if table in self.predicates:
                return spark.read.jdbc(options.pop("url"), table, predicates=self.predicates[table], properties=options)
            return spark.read.format("jdbc").options(**options, dbtable=table).load()
        return spark.table(table)


class Catalog:
    """Tables by logical name; a prefix is put before the last part of a physical name, once."""

    def __init__(self, spark: SparkSession, connections: dict[str, Connection] | None = None, prefix: str = ""):
        self.spark, self.connections, self.prefix = spark, connections or {}, prefix
        self.frames: dict[str, Callable[[], DataFrame]] = {}

    def physical(self, table: str) -> str:
        head, dot, last = table.rpartition(".")
        return table if last.startswith(self.prefix) else f"{head}{dot}{self.prefix}{last}"

    def put(self, table: str, frame: DataFrame | Callable[[], DataFrame]) -> None:
        """Names a DataFrame (or something that makes one) as a table."""
        self.frames[table] = frame if callable(frame) and not isinstance(frame, DataFrame) else lambda: frame

    def load(self, table: str, connection: str | None = None) -> DataFrame:
        if connection is None and table in self.frames:
            return self.frames[table]()
        name = connection or "default"
        if name not in self.connections:
            raise UnknownConnection(name)
        return self.connections[name].load(self.spark, self.physical(table))
