"""Writers: CSV, incremental and per-batch output, documents, reports, images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_incremental(df: DataFrame, path: str, resume: bool = True) -> None:
    """Appends where resume is set and output exists, else starts anew."""
    write_csv(df, path, "append" if resume and exists(df.sparkSession, path) else "overwrite")


def write_batches(df: DataFrame, path: str, batch: str = "batch") -> None:
    """Each batch as CSV in a folder batch_001.csv, batch_002.csv, ..., which sources.files.read_batches reads; a batch written again
    replaces only itself. All are written at once beside their places, then moved; a crash leaves old batches or new ones."""
    spark, beside = df.sparkSession, f"{path}/_writing"
    df.withColumn("__batch", F.col(batch)).write.partitionBy("__batch").mode("overwrite").option("header", True).option("escape", '"').csv(beside)
    fs, _, jvm = _fs(spark, path)
    hadoop_path = jvm.org.apache.hadoop.fs.Path
    for status in fs.listStatus(hadoop_path(beside)):
        name = status.getPath().getName()
        if name.startswith("__batch="):
            target = hadoop_path(f"{path}/batch_{int(name.removeprefix('__batch=')):03d}.csv")
            fs.delete(target, True)
            _moved(fs, status.getPath(), target)
    fs.delete(hadoop_path(beside), True)


def _moved(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"could not move {source} to {target}")


def write_document(df: DataFrame, path: str) -> None:
    """A DataFrame of one string column as a text file."""
    df.coalesce(1).write.mode("overwrite").text(path)


def write_report(spark: SparkSession, text: str, path: str) -> None:
    write_document(spark.createDataFrame([(text,)], "value string"), path)


def write_images(df: DataFrame, path: str) -> None:
    """(filename, content) kept as Parquet, a store's files being too small one by one."""
    df.select("filename", F.col("content").cast("binary").alias("content"), F.length("content").alias("length")).write.mode("overwrite").parquet(path)


def rewrite_with_backup(df: DataFrame, path: str) -> str:
    """Writes df beside path, moves the old output to path.backup and the new one into place; df may read path.

    A crash between the moves leaves the backup and the finished new output.
    """
    spark = df.sparkSession
    write_csv(df, f"{path}.new")
    fs, target, jvm = _fs(spark, path)
    backup, new = jvm.org.apache.hadoop.fs.Path(f"{path}.backup"), jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    if fs.exists(backup):
        fs.delete(backup, True)
    if fs.exists(target):
        _moved(fs, target, backup)
    _moved(fs, new, target)
    return f"{path}.backup"
