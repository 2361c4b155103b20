"""Frames cut off from their lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, computed once: written to the shared folder of ``spark.checkpoint.dir`` and read from there.

    Where the session names none, a folder in the warehouse is taken, which a cluster shares; in local mode, as in
    tests, a temporary folder that goes when the process ends.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            named = tempfile.mkdtemp(prefix="checkpoints-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.checkpoints")
    return df.checkpoint(eager=True)
