"""Session construction and the shared folder for cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime re-planning does the work that hints would freeze: it coalesces small
# shuffles, turns a join into a broadcast once the measured side is small, and
# splits skewed join partitions.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where the aggregate behind it then needs a
    # shuffle of its own; that shuffle is added only when skew is measured.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    # State of streams on local disk with checkpoints, not in executor memory.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


# Bytes at most of what one task reads of a file or a shuffle. What a task sorts or aggregates is some ten
# times as much in memory, so the engine's own 64 to 256 MB would let a task hold gigabytes.
TASK_BYTES = {
    "spark.sql.files.maxPartitionBytes": 32 << 20,
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20,
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": 32 << 20,
}
# Bytes of the tables read for each partition that a shuffle starts with. Rows of a shuffle can be several
# times as wide as those of the files; partitions that turn out small are put together at run time.
SHARE_BYTES = 4 << 20
START = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def build_session(app: str = "lectern", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**BASE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> None:
    """Session settings the plans rely on, also in sessions built elsewhere.

    Local times are computed by shifting a UTC timestamp, so the zone is pinned;
    hot users and courses are left to adaptive skew-join splitting.
    """
    for key in (
        "spark.sql.session.timeZone",
        "spark.sql.adaptive.enabled",
        "spark.sql.adaptive.skewJoin.enabled",
        "spark.sql.adaptive.forceOptimizeSkewedJoin",
        "spark.sql.streaming.stateStore.providerClass",
    ):
        if spark.conf.get(key, None) != BASE_CONF[key]:
            spark.conf.set(key, BASE_CONF[key])
    for key, most in TASK_BYTES.items():
        if size_of(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))


def widen(spark: SparkSession, size: int) -> None:
    """Let shuffles start with partitions for ``size`` bytes of input, so that what one task gets of a shuffle
    does not grow with the tables; a larger number that the session sets stays."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    now = int(spark.conf.get(START, None) or least)
    wanted = max(least, now, -(-size // SHARE_BYTES))
    if wanted > now:
        spark.conf.set(START, str(wanted))


def size_of(text: str) -> int:
    """Bytes of a size as the engine's settings give it: a number, and maybe a unit."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``, visible to every executor.

    A machine-local folder is made up only for local mode (tests); on a cluster
    a missing setting is an error, because executors could not read it back.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that no later plan reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut_lineage(df):
    """Reliable checkpoint: survives executor loss, unlike cached blocks."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
