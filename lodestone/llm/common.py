"""Shared folder, written intermediate tables and other small helpers."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a local session (as in tests) gets a folder of its own;
    on a cluster that is an error, as executors don't see each other's disks.
    """
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        there = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.sparkContext._conf.set("spark.checkpoint.dir", there)
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


_begun: set[str] = set()


def _session_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the driver ends, also where the session is stopped first."""
    path = f"{shared_dir(spark)}/lodestone-{spark.sparkContext.applicationId}"
    if path not in _begun:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(jpath)
        files.deleteOnExit(jpath)
        _begun.add(path)
    return path


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{_session_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared folder as Parquet and reads them again."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        jpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as keep it apart from the columns (in any case of letters)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """A column by its whole name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """While it holds, Python tasks get batches of at most so many rows: for rows that are large each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def doc_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id (as a long) and the text, under names of our own, so that other columns can't clash."""
    return docs.select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
