"""Consolidation of centers that arrive block by block.

The state is the set of centers kept so far: small, and for keep-first equal to
what one pass over all blocks so far would keep.  It lives in a parquet folder
with one version per batch, so a batch that is run again overwrites its own
version and reads the one before: replays change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.operators.consolidate import fold_blocks


def _state(spark, path: str, batch: int) -> list[list[float]]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    done = sorted(int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(root) if x.getPath().getName().startswith("batch="))
    before = [b for b in done if b < batch]
    return [r["center"] for r in spark.read.parquet(f"{path}/batch={before[-1]}").orderBy("pos").collect()] if before else []


def fold_batch(batch: DataFrame, number: int, path: str, threshold: float) -> None:
    """One batch: centers (block_id, center_index, center) folded into the state of ``path``."""
    spark = batch.sparkSession
    rows = [r["center"] for r in batch.filter("center is not null").orderBy("block_id", "center_index").collect()]  # local centers: few per block
    kept = fold_blocks(_state(spark, path, number), rows, threshold)
    spark.createDataFrame(list(enumerate(kept)), "pos int, center array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")


def fold_stream(stream: DataFrame, path: str, checkpoint: str, threshold: float = 0.3, **trigger) -> StreamingQuery:
    """Starts the fold of a stream of local centers; the state is read with ``current_centers``."""
    writer = stream.writeStream.foreachBatch(lambda df, n: fold_batch(df, n, path, threshold)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def current_centers(spark, path: str) -> DataFrame:
    """pos, center after the last batch."""
    kept = _state(spark, path, 1 << 62)
    return spark.createDataFrame(list(enumerate(kept)), "pos int, center array<double>")


def fold_report(spark, path: str) -> DataFrame:
    """batch, kept: the number of centers after each batch."""
    return spark.read.parquet(path).groupBy("batch").agg(F.count(F.lit(1)).alias("kept"))
