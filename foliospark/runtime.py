"""Session helpers: reading tables, cutting lineage, sizing partitions."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(app: str = "foliospark", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("FOLIO_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        # Deep expressions are built several times faster without a call site for each part.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only where a session of one machine names none, as in tests, a folder of our own is set; a cluster's session that names none is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="foliospark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint, so lost executors cost no recomputation."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager)


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of a shuffle in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by ``keys`` over all partitions of a shuffle.

    For grouped work that is heavy for its bytes: adaptive execution merges small partitions by size and would leave it to a few tasks.
    """
    return df.repartition(shuffle_width(df.sparkSession), *keys)
