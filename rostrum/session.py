"""Session helpers: a tuned builder and the reliable-storage cut point."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "rostrum", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or get) a session with the settings the operators are planned for.

    AQE stays on so that shuffle partitions are coalesced or split by measured
    size, and every broadcast is decided by Spark from known sizes (no operator
    in this package forces one).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``; a temporary folder is used
    only where that is unset (single-machine tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="rostrum-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` on reliable storage, so that several readers see the same rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
