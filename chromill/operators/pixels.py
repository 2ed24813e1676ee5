"""Pixels and the 18 channel statistics of an image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.colorspace import hsv_8bit, lab_8bit
from ..schemas import FEATURES_18


def explode_pixels(images: DataFrame, image: str = "origin") -> DataFrame:
    """(image, pos, r, g, b) from the image source's struct, whose data holds B, G, R bytes row by row; 1, 3 or 4 channels."""
    i = F.col("image")
    at = F.explode(F.sequence(F.lit(0), i["width"] * i["height"] - 1)).alias("pos")
    exploded = images.where(i["width"] > 0).select(i["origin"].alias(image), i["nChannels"].alias("n"), i["data"].alias("data"), at)

    def byte(k: int):
        place = F.col("pos") * F.col("n") + F.when(F.col("n") >= 3, k).otherwise(0) + 1
        return F.conv(F.hex(F.substring("data", place, F.lit(1))), 16, 10).cast("int")

    return exploded.select(image, "pos", byte(2).alias("r"), byte(1).alias("g"), byte(0).alias("b"))


def channels(pixels: DataFrame) -> DataFrame:
    """pixels with the nine channels of BGR, 8-bit HSV and 8-bit Lab, named as the features are."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    hsv, lab = hsv_8bit(r, g, b), lab_8bit(r, g, b)
    values = (b, g, r, hsv["h"], hsv["s"], hsv["v"], lab["lab_l8"], lab["lab_a8"], lab["lab_b8"])
    names = [n.removesuffix("_mean") for n in FEATURES_18[:9]]
    return pixels.withColumns(dict(zip(names, values, strict=True)))


def image_features(pixels: DataFrame, image: str = "image_id") -> DataFrame:
    """image and the 18 features: mean and population standard deviation of each channel, hue taken as linear."""
    names = [n.removesuffix("_mean") for n in FEATURES_18[:9]]
    wide = channels(pixels)
    return wide.groupBy(image).agg(*[F.avg(n).alias(f"{n}_mean") for n in names], *[F.stddev_pop(n).alias(f"{n}_std") for n in names])


def unique_pixels(pixels: DataFrame, image: str = "image_id") -> DataFrame:
    """Distinct colours of each image, counted from the distinct rows."""
    return pixels.select(image, "r", "g", "b").distinct().groupBy(image).agg(F.count("*").alias("n_unique"))
