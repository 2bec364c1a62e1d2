"""Session, table access and lineage helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings the operators were planned with; a caller's own session wins.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in (DEFAULTS | extra).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; Catalyst prunes columns and pushes filters into the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder checkpoints go to: the session's own setting, or (only if unset, and only locally) a temporary one.

    ``spark.checkpoint.dir`` names a folder all executors share, so a lost executor loses nothing; a cluster
    without that setting has no such folder, which is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    wanted = sc.getConf().get("spark.checkpoint.dir")
    if not wanted:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        wanted = tempfile.mkdtemp(prefix="gleanery-checkpoint-")
    sc.setCheckpointDir(wanted)
    return wanted


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder, for tables a plan writes and reads again."""
    return f"{ensure_checkpoint_dir(spark)}/gleanery-{name}-{uuid.uuid4().hex}"


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a result that must be small by construction; fail loudly beyond ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows, which this plan may not bring to the driver")
    return rows


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores before costly work on texts.

    A few small files give fewer partitions than there are cores; only then are the rows dealt out
    evenly. Inputs with partitions enough, as any large one has, are left as they are, unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def once(df: DataFrame, key: str) -> DataFrame:
    """One row per key for records that were sent twice; rows without a key can't be told apart and all stay."""
    alone = "__row_without_key"
    marked = df.withColumn(alone, F.when(F.col(key).isNull(), F.monotonically_increasing_id()))
    return marked.dropDuplicates([key, alone]).drop(alone)
