"""Session, table and shared-folder helpers used by every operator."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("momentforge")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="momentforge-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether any file or folder is at ``path``, on whatever file system its scheme names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


_made: dict[str, list[str]] = {}


def clean_up(spark: SparkSession) -> int:
    """Removes the tables that this process wrote to cut lineage, once the results that read them are written;
    the number of folders removed. On a clean end of the process it is called for its sessions."""
    done = 0
    for path in _made.pop(spark.sparkContext.applicationId, []):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        done += bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))
    return done


def _clean_at_end() -> None:
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None and spark.sparkContext._jsc is not None:
            clean_up(spark)
    except Exception:  # noqa: BLE001 - the session may have ended before
        return


atexit.register(_clean_at_end)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that all executors see: below ``spark.checkpoint.dir`` where the session
    names it, else, for a local master only, a temporary folder that goes with the process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_dir()
    path = f"{base.rstrip('/')}/mf-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back, so that a
    lost executor costs no recomputation beyond this point."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
