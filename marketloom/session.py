"""Session settings and stage tables.

Stage tables live in the folder the cluster names in ``spark.checkpoint.dir``. It is shared,
so a lost executor costs a re-read and not a re-run. Only a session without executors of its own
(master ``local[...]``) may go without that setting; it gets a temporary folder.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
_own_dirs: dict[str, str] = {}


def local_session(cores: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("marketloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Small test tables: keep all cores busy instead of merging everything into one task.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="marketloom-")
    return _own_dirs[app]


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/marketloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_stages(spark: SparkSession) -> None:
    """Remove all stage tables of this application. Results that still read them are lost: write those first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write once, read back; ``options`` go to the writer.

    For a result with several readers: each reader then scans only its columns, and the file
    size gives the optimiser a true size to choose broadcast or shuffle by.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def compiled_apart(df: DataFrame) -> DataFrame:
    """The same rows and partitions. What follows is compiled apart from what comes before: the JVM leaves a method of
    more than 8,000 bytes of code interpreted, and many wide projections over one scan become such a method."""
    return df.coalesce(1 << 20)


def by_date(df: DataFrame) -> DataFrame:
    """Broadcast a table with at most one row per DATE (years 1 to 9999: 3.7 million rows).

    The bound follows from the key's type, which is checked; a century of days is 36,525 rows.
    """
    if df.schema["dt"].dataType.simpleString() != "date":
        raise TypeError("dt must be a DATE")
    return F.broadcast(df)
