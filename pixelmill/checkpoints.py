"""Results that are computed once, in the checkpoint folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``. Only a session whose executors are threads of the driver may go without; it gets a
    folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)


#: Spark drops the shuffle files of a query as it ends, not only when the driver's garbage collection finds them.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage; the copy lies in the shared checkpoint folder, so a lost executor costs nothing.

    Once the copy is written, the shuffle files behind it go: a job of many rounds holds those of one step only."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    before = spark.conf.get(_RELEASE)
    spark.conf.set(_RELEASE, "true")
    try:
        df = df.select("*")  # the setting is read when a DataFrame is made
    finally:
        spark.conf.set(_RELEASE, before)
    return df.checkpoint(eager=True)
