"""Session construction and lineage cutting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int = 8, memory: str = "8g", app: str = "lodestrata") -> SparkSession:
    """A local session with the settings the engine expects; on a cluster the submitter sets these."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Gives the package to the workers, wherever they run; once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestrata_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="lodestrata-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    package = Path(__file__).resolve().parent
    sc.addPyFile(shutil.make_archive(f"{folder}/lodestrata", "zip", package.parent, package.name))
    sc._lodestrata_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints.

    A cluster names a shared folder in ``spark.checkpoint.dir``; it is used as it is. Where the setting is absent the
    session is a local one (tests), and a temporary folder of this machine serves.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    shared = sc.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="lodestrata-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)
    return shared


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint, which survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
