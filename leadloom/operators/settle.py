"""Rows computed once into the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def settled(rows: DataFrame) -> DataFrame:
    """`rows` as a checkpoint, so that lineage ends there. Only a local session without a checkpoint folder gets one of its own."""
    spark = rows.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            path = "file://" + tempfile.mkdtemp(prefix="leadloom-")
        context.setCheckpointDir(path)
    return rows.checkpoint()
