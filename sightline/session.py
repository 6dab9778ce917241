"""Session settings the library needs beyond the user's own."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_TABLE = 10_000  # rows of a table that every task may hold


def build_session(master: str = "local[*]", partitions: int = 8, app: str = "sightline", **conf) -> SparkSession:
    """A session for tests and benches; on a cluster use the one the cluster gives."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``: shared storage on a cluster.

    Only a local master may fall back to a fresh temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            sc.setCheckpointDir(configured)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="sightline-checkpoint-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the scratch folder.

    A checkpoint keeps the planner's guess of its size. Every join multiplies the guesses of its sides, so that over some rounds
    they get millions of digits and planning takes longer than the work; a guess beyond any table is forgotten.
    """
    scratch_folder(df.sparkSession)
    kept = df.checkpoint(eager=True)
    plan = kept._jdf.queryExecution()
    if plan.logical().stats().sizeInBytes() < 1 << 62:
        return kept
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(plan.toRdd(), kept._jdf.schema(), False), df.sparkSession)


def small_side(df: DataFrame) -> DataFrame:
    """A checkpointed table, to be broadcast if it has few rows: what it is joined to then stays where it is, so that a key
    which many rows share fills no task."""
    return F.broadcast(df) if df.count() <= SMALL_TABLE else df
