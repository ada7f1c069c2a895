"""Written tables in the shared folder of the cluster, instead of lineage.

A table lives as long as plans may read it: what a loop has left behind is deleted by ``drop``, the
rest by ``clear`` when a session has no more use for its results. Folders of sessions that are gone
may be deleted from outside; no two tables share a name.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_made: dict[str, list[str]] = {}


def root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where it is unset and the
    master is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lexloom-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path of this session that nothing else uses."""
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage ends here, and a lost
    executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop(table: DataFrame) -> None:
    """Delete a table of ``written`` that no plan reads any more."""
    spark, path = table.sparkSession, table._scratch_path
    _delete(spark, path)
    _made[spark.sparkContext.applicationId].remove(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this session has written; results that read them are gone too."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)
