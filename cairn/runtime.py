"""Session helpers: table access and durable intermediate tables.

Intermediate results that are read more than once, or that end an iterative
lineage, are written to the folder named by ``spark.checkpoint.dir``, which all
executors share.  A lost executor then costs a re-read, never a recomputation
of the whole chain.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per context.

    Workers unpickle functions by module name, and need not have the package on
    their path.
    """
    context = spark.sparkContext
    if getattr(context, "_cairn_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="cairn-package-")) / "cairn_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._cairn_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data set in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where none is set and all tasks run on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit
        pass


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Preferred to ``checkpoint()`` where the rows are used as columns later: one
    computation instead of two, and columnar files that prune.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cairn/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Deletes the files of tables that ``durable`` made and that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_cairn_path", None)
        if path:
            _remove(t.sparkSession, path)


def latest(df: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """One row per ``keys``: the ``values`` of the row with the greatest ``at``.

    Rows that share the greatest time are taken as identical.  A null time
    counts as the oldest.  Null keys form a group of their own.  ``max_by``
    combines before the shuffle, so a key delivered a million times sends one
    row per task.
    """
    when = F.coalesce(F.col(at), F.lit("0001-01-01 00:00:00").cast("timestamp"))
    return df.groupBy(*keys).agg(*(F.max_by(F.col(v), when).alias(v) for v in values))


def numbered(df: DataFrame, order: list[Column | str], name: str, kind: str = "int") -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in ``order`` (which should be unique), without one task holding all rows.

    Rows are range-partitioned and sorted, numbered within their partition, and
    the partitions' sizes (one row each) give the offsets.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    keyed = df.select("*", *(c.alias(f"__o{i}") for i, c in enumerate(columns)))
    keys = [F.col(f"__o{i}").asc_nulls_last() for i in range(len(columns))]
    placed = durable(keyed.repartitionByRange(*keys).withColumn("__p", F.spark_partition_id()))
    within = placed.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*keys)))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__b"))
    out = within.join(offsets, "__p").withColumn(name, (F.col("__b") + F.col("__r") - 1).cast(kind))
    return out.drop("__p", "__r", "__b", *(f"__o{i}" for i in range(len(columns))))


def same(a: Column, b: Column) -> Column:
    """Null-safe equality."""
    return a.eqNullSafe(b)
