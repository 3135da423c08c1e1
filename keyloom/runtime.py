"""Session helpers: the shared folder, written intermediate tables and fresh column names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: str | None = None
_CREATED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset (single-machine
    tests) a folder of our own is made and recorded.
    """
    global _OWN_DIR
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _OWN_DIR is None:
        _OWN_DIR = "file://" + tempfile.mkdtemp(prefix="keyloom-")
    return _OWN_DIR


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses; it is removed when Python ends."""
    path = f"{shared_dir(spark)}/keyloom-{label}-{uuid.uuid4().hex[:12]}"
    _CREATED.append((spark, path))
    return path


def hadoop_path(spark: SparkSession, path: str):
    """The JVM (FileSystem, Path) pair of a path."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it.

    This cuts the lineage: a lost executor costs a re-read, not a re-computation.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._keyloom_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files behind a DataFrame made by :func:`materialize`."""
    path = getattr(df, "_keyloom_path", None)
    if path:
        delete_path(df.sparkSession, path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names compare without letter case)."""
    taken = {c.lower() for c in df.columns}
    name, n = base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@atexit.register
def _cleanup() -> None:
    for spark, path in _CREATED:
        try:
            if spark.sparkContext._jsc is not None:
                delete_path(spark, path)
        except Exception:  # the session may be gone already
            return
