"""Scans of CSV files, batch folders, images and saved listing pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.html import decoded
from ..schemas import ART_PAGES, COLOURS, SCRAPE_RESULTS, require_columns


def read_csv(spark: SparkSession, path: str, schema: T.StructType, index: str | None = None) -> DataFrame:
    """A CSV file with a header under a declared schema; index names an unnamed first column."""
    if index:
        schema = T.StructType([T.StructField(index, T.StringType()), *[f for f in schema.fields if f.name != index]])
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True).csv(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A scraper's input: all strings, filename and page required; a header that lacks one raises ValueError."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path)
    return require_columns(raw, ART_PAGES.names)


def read_batches(spark: SparkSession, folder: str, schema: T.StructType, key: str = "url") -> DataFrame:
    """All batch_*.csv files of a folder, or folders of that name; the first row of each key, by file and then by its
    place in the file, wins. Broken files are passed over."""
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').option("ignoreCorruptFiles", True).option("mode", "PERMISSIVE").csv(f"{folder}/batch_*.csv")
    # rows of a block are read in order by one task, so their ids rise
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return rows.select(*schema.names, place.alias("__place")).groupBy(key).agg(F.min_by(F.struct(*schema.names), "__place").alias("__row")).select("__row.*")


def processed(spark: SparkSession, path: str, key: str = "filename", schema: T.StructType = SCRAPE_RESULTS) -> DataFrame:
    """Distinct keys of earlier output; none where there is no output yet."""
    try:
        return read_csv(spark, path, schema).select(key).distinct()
    except AnalysisException:
        return spark.createDataFrame([], T.StructType([schema[key]]))


def read_images(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """Decoded images (image struct); files that are none are dropped."""
    return spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", pattern).load(path)


def read_image_bytes(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """Image files as they are: path, length and content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def head(df: DataFrame, n: int, order: str = "pos") -> DataFrame:
    """The first n rows in the given order."""
    return df.orderBy(order).limit(n)


def palette(spark: SparkSession) -> DataFrame:
    """The basic colours as a relation: ord, name, r, g, b."""
    return spark.createDataFrame([(i, n, *rgb) for i, (n, rgb) in enumerate(COLOURS.items())], "ord int, name string, r int, g int, b int")


#: A tile of a listing page: the link, then the style of its image.
_TILE = r"""(?is)<a\b[^>]*href=["']([^"']+)["'][^>]*>.*?background-image:\s*(none|url\([^)]*\))"""


def read_listings(spark: SparkSession, path: str, colour: str) -> DataFrame:
    """page, image and color of each tile of the saved listing pages at path, which any store that Spark reads may hold. Stands for the browser crawl.

    Tiles come in any order; character references are resolved before they are looked for.
    """
    pages = spark.read.text(path, wholetext=True).select(decoded("value").alias("html"))
    tiles = pages.select(F.explode(F.regexp_extract_all("html", F.lit(_TILE), F.lit(0))).alias("tile"))
    return tiles.select(F.regexp_extract("tile", _TILE, 1).alias("page"), F.regexp_extract("tile", _TILE, 2).alias("image"), F.lit(colour).alias("color"))
