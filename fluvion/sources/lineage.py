"""Cutting the lineage of iterated plans in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """What ``df`` gives, written once to the checkpoint folder: a plan that reads its own
    last round twice would otherwise double with every round. The folder is that of
    ``spark.checkpoint.dir``; without one, a temporary folder of the driver on a local master,
    and an error on a cluster, whose executors don't share it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="fluvion-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
