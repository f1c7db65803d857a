"""Session settings the operators rely on, and the checkpoint folder rule."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only: they can be applied to a session somebody else built.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join followed by a group-by on the same key is split too when one key is hot,
    # at the price of one more exchange on the already reduced rows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Joins whose shuffled partitions all turn out to fit a 64 MB hash table skip the sorts.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # Shuffle files go when the query that wrote them has ended, not when the driver collects its garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for name, value in RUNTIME_CONF.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; on a cluster use the session the cluster hands out."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cohortline")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Python call sites are not recorded for every column expression, which shortens plan building.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


# Where a local session without a checkpoint folder keeps written intermediates.
LOCAL_FOLDER = "/tmp/checkpoints/cohortline"


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names for checkpoints; one is set only for a local session that names none."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(LOCAL_FOLDER)
    return context.getCheckpointDir()


_scopes: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Intermediates written inside are removed at the end, also after an error.

    Frames made inside read them, so results must be written or collected before the scope ends.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove_scratch(spark, path)


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, known to the innermost ``scratch_scope``."""
    path = f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def write_scratch(df: DataFrame) -> str:
    """Write the frame to a new path in the shared folder."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return path


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Remove what ``write_scratch`` wrote, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and read it back: the lineage ends at files any executor can reach."""
    return df.sparkSession.read.schema(df.schema).parquet(write_scratch(df))
