"""Cuts of lineage in the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame

from ..errors import InvalidArgument


def written(df: DataFrame) -> DataFrame:
    """The same rows, written to the folder that spark.checkpoint.dir names and read from there.

    Where it is unset a local session (as in tests) gets a folder of its own; on
    a cluster that is an error, as executors don't see each other's disks.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        there = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not there:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise InvalidArgument("spark.checkpoint.dir must name a folder that the driver and all executors share")
            there = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        context.setCheckpointDir(there)
    return df.checkpoint()
