"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "bootframe") -> SparkSession:
    """A local session for tests and benchmarks (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster this setting names a shared folder and is used as is; if it is
    unset there, this fails rather than fall back to a machine-local folder. Only a
    local-mode session (tests) without the setting gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    path = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by the cluster")
        path = tempfile.mkdtemp(prefix="bootframe-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, path)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path


def parallelism(spark: SparkSession) -> int:
    """Cores available to the job (classic sessions); the shuffle width where the
    context is not reachable (Spark Connect)."""
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001 - remote sessions have no SparkContext
        return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_partitions(df: DataFrame, default: int) -> int:
    """Number of input splits (classic sessions); assume enough where unknown."""
    try:
        return df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - remote sessions expose no RDD
        return default


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared checkpoint folder and read back.

    The written table survives the loss of any executor (never ``localCheckpoint``). Unlike
    ``checkpoint()`` it computes ``df`` once, is compressed, and lets later steps read single columns.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
