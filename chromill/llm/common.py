"""What several operators share: words, hashes, cuts of the lineage, size-checked joins."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"

#: A join side is broadcast up to so many bytes, counted before; beyond, the join shuffles.
BROADCAST_BYTES = 32 << 20


#: Bytes of an Arrow batch that goes to a Python worker; Spark's own bound is eight times as much, and a text's copies add up.
ARROW_BYTES = 8 << 20
_ARROW_SETTING, _ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by ARROW_BYTES, unless the session has a bound of its own."""
    if spark.conf.get(_ARROW_SETTING).rstrip("b") == str(_ARROW_DEFAULT):
        spark.conf.set(_ARROW_SETTING, str(ARROW_BYTES))


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a new one on a local master, as in tests; else an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="chromill-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and written to the checkpoint folder; what follows does not depend on executors living."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def sever(df: DataFrame) -> DataFrame:
    """cut(df), without what a checkpoint takes over from its plan: estimated size, partitioning and constraints.

    A join's estimated size is the product of its sides'. In a loop that joins its own results the number's digits so
    multiply by four a round, and planning fills the driver's heap with them, however few the rows are.
    """
    jdf = cut(df)._jdf
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(jdf.queryExecution().toRdd(), jdf.schema(), False), spark)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path through Hadoop's file system, whatever store holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Has the driver's heap collected: only then does Spark drop broadcasts and shuffles that nothing refers to any more, and is memory given back."""
    gc.collect()  # data frames that Python holds in cycles keep theirs alive
    spark.sparkContext._jvm.System.gc()


def _length(df: DataFrame, name: str) -> Column:
    """Bytes of a column's value beyond eight."""
    kind, c = df.schema[name].dataType.typeName(), F.col(f"`{name}`")
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if kind in ("struct", "array", "map"):
        return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0))
    return F.lit(0)


def fits(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether df's rows take at most so many bytes: 16 a row, 8 a column, and what strings and nested values hold. Reads few rows more than that."""
    width = 16 + 8 * len(df.columns)
    rows = max(1, most // width)
    n, held = df.limit(rows + 1).agg(F.count("*"), F.sum(sum((_length(df, c) for c in df.columns), F.lit(0)).cast("long"))).first()
    return n <= rows and n * width + (held or 0) <= most


def lookup(left: DataFrame, right: DataFrame, on, how: str = "left", most: int = BROADCAST_BYTES) -> DataFrame:
    """Joins right to left: broadcast if its counted bytes are few, else by a shuffle whose skew AQE splits.

    right should be cut or cheap, as its rows are counted first.
    """
    return left.join(F.broadcast(right) if fits(right, most) else right, on, how)


def unused(name: str, *frames: DataFrame) -> str:
    """name, with marks added until no column of frames is called so; names match as Spark compares them."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def size_words(text: Column) -> Column:
    """Words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5, the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def columns(df: DataFrame) -> list[Column]:
    """All columns of df by name, whatever characters the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def replacing(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names, which the caller adds; names match as Spark compares them."""
    lower = {n.lower() for n in names}
    return df.select(*[c for name, c in zip(df.columns, columns(df), strict=True) if name.lower() not in lower])
