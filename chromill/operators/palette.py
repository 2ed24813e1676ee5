"""From raw colours to shares of the twelve basic ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.colorspace import lab_of, with_ciede2000, with_lab
from ..schemas import COLOUR_NAMES, COLOURS
from ..session import fixed
from . import engineered


def basic_palette(spark: SparkSession) -> DataFrame:
    """The 12 basic colours: ord, name, RGB and their Lab, computed once."""
    rows = [(i, n, *rgb, *lab_of(rgb)) for i, (n, rgb) in enumerate(COLOURS.items())]
    return spark.createDataFrame(rows, "ord int, name string, p_r int, p_g int, p_b int, p_l double, p_a double, p_lab_b double")


def colour_differences(colours: DataFrame) -> DataFrame:
    """Each (r, g, b) with each basic colour and their CIEDE2000 difference: 12 rows a colour, by broadcasting the fixed palette."""
    pairs = with_lab(colours).join(F.broadcast(basic_palette(colours.sparkSession)))
    return with_ciede2000(pairs, ("lab_l", "lab_a", "lab_b"), ("p_l", "p_a", "p_lab_b"))


def nearest_basic(colours: DataFrame, key: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """The nearest basic colour of each key; differences equal to nine places fall to the first name."""
    ranked = F.struct(F.round("delta_e", 9).alias("d"), "ord", "name")
    return colour_differences(colours).groupBy(*key).agg(F.min(ranked).alias("best")).select(*key, F.col("best.name").alias("name"), F.col("best.d").alias("delta_e"))


def shares_by_image(pixels: DataFrame, image: str = "image_id") -> DataFrame:
    """Per image the share of its pixels nearest to each basic colour, all 12 columns, zeros kept.

    Distances are computed once for each distinct colour, not for each pixel.
    """
    counted = pixels.groupBy(image, "r", "g", "b").agg(F.count("*").alias("n"))
    named = nearest_basic(counted.select("r", "g", "b").distinct()).select("r", "g", "b", "name")
    pivoted = counted.join(named, ["r", "g", "b"]).groupBy(image).agg(F.sum("n").alias("total"), *[F.sum(F.when(F.col("name") == c, F.col("n")).otherwise(0)).alias(c) for c in COLOUR_NAMES])
    return pivoted.select(image, *[(F.col(c) / F.col("total")).alias(c) for c in COLOUR_NAMES])


def basic_shares(clustered: DataFrame, image: str = "url") -> DataFrame:
    """From (image, r, g, b, share) rows to smoothed shares of the basic colours. The rows are computed once, as they are used twice."""
    clustered = fixed(clustered)
    named = nearest_basic(clustered.select("r", "g", "b").distinct()).select("r", "g", "b", "name")
    summed = clustered.join(named, ["r", "g", "b"]).groupBy(image).agg(*[F.sum(F.when(F.col("name") == c, F.col("share")).otherwise(0.0)).alias(c) for c in COLOUR_NAMES])
    return engineered.smooth(summed)


#: Distances held at once: they stay in a core's cache, and a product of this size is not spread over threads.
_HELD = 1 << 16


def kmeans_plus_plus(points: np.ndarray, k: int, starts: int, draw: np.random.Generator) -> np.ndarray:
    """k-means++ for all starts at once, centres as (starts, k, columns): far points are likelier, each point keeps its smallest gap."""
    chosen = [points[draw.integers(len(points), size=starts)]]
    gap = np.full((starts, len(points)), np.inf)
    for _ in range(k - 1):
        np.minimum(gap, sum((points[:, j] - chosen[-1][:, j, None]) ** 2 for j in range(points.shape[1])), out=gap)
        upto, at = gap.cumsum(1), draw.random(starts)
        far = (upto <= (at * upto[:, -1])[:, None]).sum(1)
        chosen.append(points[np.where(upto[:, -1] > 0, np.minimum(far, len(points) - 1), (at * len(points)).astype(int))])
    return np.stack(chosen, 1)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each point under each start, as (points, starts); the squares of the points are left out, as they change no order."""
    starts, k, _ = centres.shape
    flat = centres.reshape(starts * k, -1)
    double, squares, out = -2.0 * flat.T, (flat * flat).sum(1), np.empty((len(points), starts), np.int64)
    step = max(1, _HELD // (starts * k))
    for at in range(0, len(points), step):
        gaps = points[at : at + step] @ double
        gaps += squares
        gaps.reshape(-1, starts, k).argmin(2, out=out[at : at + step])
    return out


def _lloyd(points: np.ndarray, k: int, seed: int, starts: int, rounds: int = 50) -> np.ndarray:
    """The best centres of several starts, which go through their rounds together until each stands still."""
    centres = kmeans_plus_plus(points, k, starts, np.random.default_rng(seed))
    label, going = np.empty((len(points), starts), np.int64), np.arange(starts)
    for _ in range(rounds):
        own, now = centres[going], len(going)
        label[:, going] = near = _nearest(points, own)
        place = (near + np.arange(now) * k).ravel()
        n = np.bincount(place, minlength=now * k)
        total = np.stack([np.bincount(place, np.repeat(points[:, j], now), now * k) for j in range(points.shape[1])], 1)
        moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], own.reshape(now * k, -1)).reshape(own.shape)
        still = np.isclose(moved, own).all((1, 2))
        centres[going[~still]] = moved[~still]
        going = going[~still]
        if not len(going):
            break
    costs = [((points - centres[s][label[:, s]]) ** 2).sum() for s in range(starts)]
    return centres[int(np.argmin(costs))]


def dominant_colours(pixels: DataFrame, image: str = "image_id", k: int = 30, max_unique: int = 10_000, starts: int = 3, seed: int = 42) -> DataFrame:
    """(image, label, r, g, b, share): k-means over each image's distinct pixels, shares over all its pixels.

    Pixels are counted by colour before they meet, so a task sees an image's distinct colours only; of more
    than max_unique, a seeded sample places the centres. An image of fewer than two colours gives no row.
    Centres are cut to whole numbers; a centre that no pixel takes is left out.
    """
    counted = pixels.groupBy(image, "r", "g", "b").agg(F.count("*").alias("n"))
    kind = counted.schema[image].dataType.simpleString()

    def fit(own: pa.Table) -> pa.Table:
        points = np.stack([own[c].to_numpy().astype(float) for c in "rgb"], 1)
        order = np.lexsort(points.T[::-1])
        points, n = points[order], own["n"].to_numpy()[order]
        label = np.empty(0, np.int64)
        centres, share = np.empty((0, 3)), np.empty(0)
        if len(points) > 1:
            chosen = points if len(points) <= max_unique else points[np.sort(np.random.default_rng(seed).choice(len(points), max_unique, replace=False))]
            centres = _lloyd(chosen, min(k, len(chosen)), seed, starts)
            label = _nearest(points, centres[None])[:, 0]
            share = np.bincount(label, n, len(centres)) / n.sum()
        held = np.flatnonzero(share)
        whole = centres[held].astype(np.int32)
        images = own[image].combine_chunks().take(pa.array(np.zeros(len(held), np.int64)))
        return pa.table([images, pa.array(held, pa.int32()), *[pa.array(whole[:, j]) for j in range(3)], pa.array(share[held], pa.float64())], names=[image, "label", "r", "g", "b", "share"])

    return counted.groupBy(image).applyInArrow(fit, f"{image} {kind}, label int, r int, g int, b int, share double")


def parse_percent(df: DataFrame, names: tuple[str, ...] = COLOUR_NAMES) -> DataFrame:
    """Percent strings such as '56.55%' as fractions; what is not a number becomes null."""
    return df.withColumns({c: F.expr(f"try_cast(rtrim('%', {c}) AS double)") / 100 for c in names})
