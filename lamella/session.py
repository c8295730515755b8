"""What every query needs from its Spark session: tables, shared scratch space, shipped code."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHIPPED: set[str] = set()
_WRITTEN: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory; the path may be in any store Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of one batch for a Python worker; texts can be long, and workers share an executor's memory.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def ship(spark: SparkSession) -> None:
    """Make a session ready for Python workers.

    Batches are kept small, and this package is sent to the executors once per
    application, so that workers can import it.
    """
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    stage = tempfile.mkdtemp(prefix="lamella-code-")
    root = os.path.join(stage, "src")
    shutil.copytree(here, os.path.join(root, "lamella"), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(stage, "lamella_code"), "zip", root))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where none is named and there is one machine, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        named = "file://" + tempfile.mkdtemp(prefix="lamella-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame, few: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    ``few`` is for tables that are small beside the input, such as links: they
    are written in no more parts than twice the cluster's cores, however many
    shuffle partitions the session has.

    This cuts the lineage: a lost executor costs the tasks in flight, never the
    stages before the cut, and the planner gets the true size of the table.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lamella-{uuid.uuid4().hex}"
    out = df.coalesce(2 * spark.sparkContext.defaultParallelism) if few else df
    out.write.parquet(path)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._lamella_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_lamella_path", None)
        if path and path in _WRITTEN:
            _remove(path, _WRITTEN.pop(path))


#: Rows and bytes of a side that is broadcast, at most; a larger one is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 48 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df`` for broadcast if its rows and bytes have been counted to be few, else as it is."""

    def width(field: T.StructField) -> Column:
        own, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return F.greatest(F.size(own), F.lit(0)) * 16 + 16
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(own), F.lit(0)) + 16
        return F.lit(32 if isinstance(kind, T.StructType) else 8)

    rows, size = df.agg(F.count("*"), F.sum(sum(map(width, df.schema.fields), F.lit(16)).cast("long"))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def hashed(df: DataFrame) -> DataFrame:
    """``df`` as the smaller side of a join: both sides are shuffled, and this one is hashed part by part.

    For joins with rows that come from ``explode``. The planner takes them for
    as few as the rows before it, and might broadcast them.
    """
    return df.hint("shuffle_hash")


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished plans, which Spark keeps until the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _remove(path: str, spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _tidy() -> None:
    for path, spark in list(_WRITTEN.items()):
        try:
            _remove(path, spark)
        except Exception:  # noqa: BLE001  the gateway may have gone before us
            return
