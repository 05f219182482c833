"""Tables cut from their lineage, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Folders that are still there, and the session that made each.
_LEFT: dict[str, SparkSession] = {}
#: More partitions than a driver can keep count of help nobody.
MOST_PARTITIONS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the session names one; in local mode a temporary folder otherwise. On a
    cluster there is no folder that all machines share unless the session names it."""
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that {master} shares")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tidelog-")
    return _OWN[app]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: later stages restart from
    the files when an executor is lost, and none of them computes df again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidelog/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch_path = path
    _LEFT[path] = spark
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that materialise made and that nothing reads any more."""
    path = df._scratch_path
    spark = _LEFT.pop(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _discard_all() -> None:
    for path, spark in list(_LEFT.items()):
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone already; the folder is the cluster's to clear then
            return


def partitions(spark: SparkSession, total_bytes: int = 0, bytes_each: int = 16 << 20) -> int:
    """Partitions for an exchange: the session's setting, or more where total_bytes asks for it."""
    wanted = min(-(-int(total_bytes) // bytes_each), MOST_PARTITIONS)
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), wanted)


def modest_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Arrow batches of whole texts: fewer rows than Spark's default of 10,000, unless the session says how many.
    The setting stays, as Spark reads it only when the plan runs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))
