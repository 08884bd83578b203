"""Readers and writers of tables, matrices, labels, blocks and centers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_chunks(spark: SparkSession, folder: str, prefix: str = "chunk_") -> list[DataFrame]:
    """The tables in the folders ``prefix*`` of ``folder``, in order of their names."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return [spark.read.parquet(p) for p in sorted(x.getPath().toString() for x in found if x.isDirectory() and x.getPath().getName().startswith(prefix))]


def read_csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = False, infer: bool = False) -> DataFrame:
    """A CSV file; without ``schema`` and ``infer`` every cell is a string."""
    reader = spark.read.option("header", header).option("mode", "FAILFAST" if schema else "PERMISSIVE")
    return (reader.schema(schema) if schema else reader.option("inferSchema", infer)).csv(path)


def read_matrix(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """path, v of a headerless numeric CSV file or folder: trimmed cells, blank lines skipped.

    ``strict`` raises on a bad cell; otherwise a row with one is dropped.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), "value").filter(F.trim("value") != "")
    cells = F.split("value", ",")
    if strict:
        return lines.select("path", F.transform(cells, lambda x: F.trim(x).cast("double")).alias("v"))
    v = F.transform(cells, lambda x: F.trim(x).try_cast("double"))
    return lines.select("path", v.alias("v")).filter(~F.exists("v", lambda x: x.isNull()))


def read_block_folder(spark: SparkSession, folder: str) -> DataFrame:
    """block_id, v of a folder of CSV files: one block per file in order of their names.

    A file without rows is a block without rows: it keeps its number.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = sorted(x.getPath().getName() for x in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path) if x.getPath().getName().lower().endswith(".csv"))
    numbered = spark.createDataFrame([(n, i) for i, n in enumerate(files)], "name string, block_id int")
    rows = read_matrix(spark, f"{folder.rstrip('/')}/*.csv", strict=False).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return rows.join(numbered, "name").select("block_id", "v")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """label: one whole number per line, blanks skipped."""
    return spark.read.text(path).filter(F.trim("value") != "").select(F.trim("value").cast("int").alias("label"))


def read_records(spark: SparkSession, path: str, n_attributes: int = 4) -> DataFrame:
    """v, label of CSV lines with ``n_attributes`` numbers and a class name; blank lines are skipped."""
    cells = F.split("value", ",")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.transform(F.slice(cells, 1, n_attributes), lambda x: F.trim(x).cast("double")).alias("v"), F.trim(F.get(cells, F.lit(n_attributes))).alias("label"))


def nested_centers(table: DataFrame, column: str = "centers_list", block: str = "partition_id") -> DataFrame:
    """partition_id, center_index, center_values of a table with one list of centers per block."""
    return table.select(block, F.posexplode(column).alias("center_index", "center_values"))


def write_flat_centers(centers: DataFrame, path: str) -> None:
    """partition_id, center_index, center_values as snappy parquet."""
    centers.select("partition_id", "center_index", "center_values").write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_parquet(df: DataFrame, path: str, single_file: bool = False, blocks: bool = False) -> None:
    """``df`` as parquet; ``single_file`` only for results that one task can write, ``blocks`` one folder per block_id in one pass."""
    out = (df.coalesce(1) if single_file else df).write.mode("overwrite")
    (out.partitionBy("block_id") if blocks else out).parquet(path)


def write_arrivals(df: DataFrame, by: str, path: str) -> None:
    """One parquet file per value of ``by``, dated in their order, as a stream would bring them."""
    df.repartition(by).withColumn("__by", F.format_string("%012d", F.col(by).cast("bigint"))).write.partitionBy("__by").parquet(path)
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = sorted(x.getPath().toString() for x in fs.listStatus(root) if x.isDirectory())
    for k, folder in enumerate(folders):
        for x in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder)):
            fs.setTimes(x.getPath(), 1_700_000_000_000 + 1000 * k, -1)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).csv(path)


def write_matrix(points: DataFrame, path: str, v: str = "v") -> None:
    """One line per row, elements separated by commas, no header."""
    points.select(F.array_join(F.transform(v, lambda x: x.cast("string")), ",").alias("value")).write.mode("overwrite").text(path)


def write_block_folder(blocks: DataFrame, n: int, path: str) -> None:
    """One CSV file per block 0..n-1 (block_id, v), in one pass; a block without rows gets an empty file."""
    lines = blocks.select("block_id", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("value"))
    lines.repartition("block_id").write.partitionBy("block_id").text(f"{path}/parts")
    spark = blocks.sparkSession
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for b in range(n):
        folder, target = at(f"{path}/parts/block_id={b}"), at(f"{path}/block{b:05}.csv")
        if fs.exists(folder):
            fs.rename(next(x.getPath() for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-")), target)
        else:
            fs.create(target).close()
    fs.delete(at(f"{path}/parts"), True)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One value per line."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def fixed_decimals(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """``columns`` as text with a fixed number of decimals, for reports."""
    return df.select(*(F.format_string(f"%.{digits}f", F.col(c).cast("double")).alias(c) if c in columns else F.col(c) for c in df.columns))


def exploded_elements(df: DataFrame, column: str, size: int) -> DataFrame:
    """``df`` with one column per element of an array, ready for CSV."""
    return df.select(*(c for c in df.columns if c != column), *(F.get(F.col(column), F.lit(i)).alias(f"{column}_{i}") for i in range(size)))


def scatter(points: DataFrame, centers: DataFrame) -> DataFrame:
    """x, y, kind (point or center): what a plot of the first two coordinates needs."""
    two = lambda c, k: (F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y"), F.lit(k).alias("kind"))
    return points.select(*two(F.col("v"), "point")).unionByName(centers.select(*two(F.col("center"), "center")))


def dump_distances(distances: DataFrame, path: str) -> DataFrame:
    """A debugging dump: ``distances`` as CSV lines without header; gives ``distances`` back."""
    write_csv(distances, path, header=False)
    return distances


#: The columns of the three statistics files.
STATISTICS = {
    "local": ["partition", "local_centers", "total_local_centers", "avg_local_centers"],
    "merged": ["partition", "total_local_centers", "avg_local_centers", "merged_centers", "compression_ratio", "reduction_percentage"],
    "incremental": ["partition", "total_local_centers", "avg_local_centers", "merged_centers", "compression_ratio", "reduction_percentage"],
}


def statistics_file(stats: DataFrame, kind: str, extra: dict[str, str] | None = None) -> DataFrame:
    """``consolidate.cumulative_statistics`` in one of the three report forms, ratios with six decimals.

    The incremental form takes ``extra``: names and values of further columns.
    """
    if kind not in STATISTICS:
        raise ValueError("kind must be local, merged or incremental")
    if extra and kind != "incremental":
        raise ValueError("only the incremental form has further columns")
    named = stats.select(F.col("partitions").alias("partition"), "local_centers", F.col("total").alias("total_local_centers"), F.col("average").alias("avg_local_centers"), F.col("merged").alias("merged_centers"), F.col("ratio").alias("compression_ratio"), F.col("reduction").alias("reduction_percentage"))
    shown = fixed_decimals(named.select(*STATISTICS[kind]), [c for c in STATISTICS[kind] if c in ("compression_ratio", "reduction_percentage")])
    return shown.select("*", *(F.lit(v).alias(k) for k, v in (extra or {}).items()))
