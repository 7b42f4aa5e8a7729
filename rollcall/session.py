"""Session and table-loading helpers.

Every operator in the package takes DataFrames and returns DataFrames; this
module only builds a session with settings that suit the operators (UTC, AQE,
skew handling) and reads the driver's parquet tables.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

# Settings every session of the package relies on.  The time zone matters for
# correctness (all timestamps are zone-less); the rest are scale settings.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # zone-less parquet timestamps stay TIMESTAMP_NTZ
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "rollcall") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in SESSION_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("ROLLCALL_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_session_conf(spark: SparkSession) -> SparkSession:
    """Apply the runtime-settable part of SESSION_CONF to an existing session.

    Results depend on the time zone and the zone-less timestamp settings, so a
    setting that cannot be applied raises.
    """
    for k, v in SESSION_CONF.items():
        if not k.startswith("spark.ui."):      # static: only the session's builder can set these
            spark.conf.set(k, v)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder for checkpoints and stored intermediate tables.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is.  Only a local master (tests, bench) may do without: it gets a scratch
    folder of its own.  Any other master without the setting is an error,
    since executors would each write to their own disks.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="rollcall-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", current)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(current)
    return current


def ship_package(spark: SparkSession) -> None:
    """Let Python workers on the driver's host import this package by path.

    On a cluster the package is installed on the executors or sent with
    ``--py-files``; the extra path entry is then without effect.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt over the tasks by ``keys``, in a number of partitions that adaptive execution does not lower: rows that are
    few bytes but much work would else stay in the few tasks of their file's row groups."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Tables:
    """Lazy access to the driver tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in DRIVER_TABLES:
            return read_table(self.spark, self.sf_dir, name)
        raise AttributeError(name)
