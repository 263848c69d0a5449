"""SparkSession factory and the few settings every job relies on."""

from __future__ import annotations

import gc
import os
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, app: str = "rollbook", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; a cluster session is built by its own launcher."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    importable(spark)
    return spark


def importable(spark: SparkSession) -> None:
    """Python workers started from now on look for this package where the driver found it, wherever they were started.

    On a cluster the package is installed at that path on every machine, or shipped with --py-files.
    """
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by spark.checkpoint.dir; a temporary one only when a local session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        folder = tempfile.mkdtemp(prefix="rollbook-ckpt-", dir=os.environ.get("TMPDIR"))
    sc.setCheckpointDir(folder)
    return folder


_CONSTRAINTS = "spark.sql.constraintPropagation.enabled"
#: Least seconds between two releases.
RELEASE_S = 2.0
_released = [0.0]


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints that nothing refers to any more.

    It does so when the driver's garbage is collected, which happens too rarely for a job of many stages.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _released[0] = time.monotonic()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, so that later plans start from files that survive lost executors.

    What led to earlier checkpoints is released first, so the disk holds about what one step needs.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if time.monotonic() - _released[0] > RELEASE_S:
        release(spark)
    # Else each checkpoint inherits the constraints of the plan before it, which in loops grow until planning takes minutes.
    before = spark.conf.get(_CONSTRAINTS, None)
    spark.conf.set(_CONSTRAINTS, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(_CONSTRAINTS, before or "true")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df over all cores before costly Python work on few bytes.

    A fixed number of partitions is not coalesced again; a hash of the columns is no partitioning the planner could take as given.
    """
    spark = df.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    return df.repartition(n, F.xxhash64(*columns))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have, compared without case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base
