"""From twelve colour shares to the engineered features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ANALOGOUS, COLOUR_NAMES, COLOURS, COMPLEMENTARY, COOL, ENGINEERED_73, NEUTRAL, PAIRS, PRIMARY, WARM, require_columns

EPS = 0.001
SMOOTHING, FLOOR = 0.012, 0.001


def _flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def _sum(names) -> Column:
    total = F.col(names[0])
    for n in names[1:]:
        total = total + F.col(n)
    return total


def _shares() -> Column:
    return F.array(*[F.col(c) for c in COLOUR_NAMES])


def normalise(df: DataFrame) -> DataFrame:
    """Shares divided by their sum; a zero sum becomes equal shares."""
    total = _sum(COLOUR_NAMES)
    return df.withColumn("__total", total).withColumns({c: F.when(F.col("__total") > 0, F.try_divide(F.col(c), F.col("__total"))).otherwise(F.lit(1.0 / len(COLOURS))) for c in COLOUR_NAMES}).drop("__total")


def smooth(df: DataFrame) -> DataFrame:
    """Normalised shares drawn towards equal ones, v (1 - 0.012) + 0.001; they still sum to 1."""
    return normalise(df).withColumns({c: F.least(F.greatest(F.col(c) * (1 - SMOOTHING) + FLOOR, F.lit(FLOOR)), F.lit(1 - FLOOR)) for c in COLOUR_NAMES})


def ratios() -> dict[str, Column]:
    return {f"{a}_{b}_ratio": F.col(a) / (F.col(b) + EPS) for a, b in PAIRS}


def dominance() -> dict[str, Column]:
    return {f"{a}_{b}_dominance": _flag(F.col(a) > F.col(b)) for a, b in PAIRS}


def harmony() -> dict[str, Column]:
    out = {f"{a}_{b}_complementary": _flag((F.col(a) > 0.1) & (F.col(b) > 0.1)) for a, b in COMPLEMENTARY}
    return out | {f"analogous_group_{i}": _flag((F.col(a) > 0.05) & (F.col(b) > 0.05) & (F.col(c) > 0.05)) for i, (a, b, c) in enumerate(ANALOGOUS, 1)}


def temperature() -> dict[str, Column]:
    warm, cool = _sum(WARM), _sum(COOL)
    return {"warm_colors_total": warm, "cool_colors_total": cool, "neutral_colors_total": _sum(NEUTRAL), "warm_cool_balance": F.abs(warm - cool), "warm_cool_ratio": warm / (cool + EPS)}


def diversity(compat: bool = True) -> dict[str, Column]:
    """Counts and spread. palette_variance is the population standard deviation; without compat, its square."""
    shares = _shares()
    mean = _sum(COLOUR_NAMES) / float(len(COLOURS))
    squares = F.aggregate(shares, F.lit(0.0), lambda t, x: t + (x - mean) * (x - mean)) / float(len(COLOURS))
    spread = F.sqrt(squares) if compat else squares
    return {
        "num_dominant_colors": F.size(F.filter(shares, lambda x: x > 0.1)).cast("double"),
        "palette_variance": spread,
        "primary_dominance": _sum(PRIMARY),
        "color_diversity": F.size(F.filter(shares, lambda x: x > 0.05)).cast("double"),
        "color_balance": F.lit(1.0) - spread,
    }


def dominant_colour() -> Column:
    """The name with the largest share, the first of equals in the colours' order."""
    names = F.array(*[F.lit(c) for c in COLOUR_NAMES])
    shares = _shares()
    return F.element_at(names, F.array_position(shares, F.array_max(shares)).cast("int"))


def dominant_temperature(name: Column) -> Column:
    return F.when(name.isin(*WARM), "warm").when(name.isin(*COOL), "cool").when(name.isin(*NEUTRAL), "neutral").otherwise("none")


def dominant_flags() -> dict[str, Column]:
    kind = dominant_temperature(dominant_colour())
    return {f"dominant_is_{t}": _flag(kind == t) for t in ("warm", "cool", "neutral")}


def features_85(df: DataFrame, key: str = "url", compat: bool = True) -> DataFrame:
    """key, the 12 shares and the 73 engineered features, in order. All are one projection."""
    require_columns(df, (key, *COLOUR_NAMES))
    made = df.select(key, *COLOUR_NAMES, *[e.alias(n) for part in (ratios(), dominance(), harmony(), temperature(), diversity(compat), dominant_flags()) for n, e in part.items()])
    return made.select(key, *COLOUR_NAMES, *ENGINEERED_73)


def validation(features: DataFrame) -> DataFrame:
    """Per colour: min, max and mean share, and how many lie outside the open interval from 0 to 1."""
    long = features.unpivot([], list(COLOUR_NAMES), "colour", "share")
    outside = F.count_if((F.col("share") <= 0) | (F.col("share") >= 1))
    return long.groupBy("colour").agg(F.min("share").alias("min_share"), F.max("share").alias("max_share"), F.avg("share").alias("avg_share"), F.stddev_pop("share").alias("std_share"), outside.alias("violations"))


def binary_violations(features: DataFrame) -> DataFrame:
    """How many values of each flag column are neither 0 nor 1."""
    flags = [n for n in ENGINEERED_73 if n.endswith(("_dominance", "_complementary")) and n != "primary_dominance" or n.startswith(("analogous_", "dominant_is_"))]
    return features.unpivot([], flags, "flag", "value").groupBy("flag").agg(F.count_if(~F.col("value").isin(0.0, 1.0)).alias("violations"))
