"""Names, orders and schemas of the colour data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The basic colours in alphabetical order, which breaks ties, and their RGB.
COLOURS = {
    "black": (0, 0, 0),
    "blue": (0, 0, 255),
    "brown": (139, 69, 19),
    "green": (0, 128, 0),
    "grey": (128, 128, 128),
    "orange": (255, 165, 0),
    "pink": (255, 192, 203),
    "purple": (128, 0, 128),
    "red": (255, 0, 0),
    "turquoise": (64, 224, 208),
    "white": (255, 255, 255),
    "yellow": (255, 255, 0),
}
COLOUR_NAMES = tuple(COLOURS)

# The ordered pairs of the ratio and dominance features.
PAIRS = (
    ("red", "blue"), ("red", "green"), ("red", "yellow"), ("red", "purple"), ("blue", "yellow"),
    ("blue", "orange"), ("blue", "green"), ("blue", "purple"), ("yellow", "purple"), ("yellow", "green"),
    ("yellow", "orange"), ("green", "purple"), ("green", "orange"), ("purple", "orange"), ("black", "white"),
    ("black", "grey"), ("black", "brown"), ("white", "grey"), ("white", "brown"), ("grey", "brown"),
    ("red", "orange"), ("orange", "yellow"), ("blue", "turquoise"), ("green", "turquoise"), ("purple", "pink"),
    ("red", "pink"),
)
# Colour harmonies and temperature groups. Pink belongs to no group.
COMPLEMENTARY = (("red", "green"), ("blue", "orange"), ("yellow", "purple"))
ANALOGOUS = (("red", "orange", "yellow"), ("yellow", "green", "blue"), ("blue", "purple", "red"), ("green", "blue", "turquoise"), ("purple", "pink", "red"))
WARM, COOL, NEUTRAL = ("red", "orange", "yellow", "brown"), ("blue", "green", "purple", "turquoise"), ("black", "white", "grey")
PRIMARY = ("red", "blue", "yellow")

_SPACES = {"bgr": "bgr", "hsv": "hsv", "lab": "lab"}
#: Means of the nine channels, then their standard deviations.
FEATURES_18 = tuple(f"{c}_{space}_{stat}" for stat in ("mean", "std") for space, channels in _SPACES.items() for c in channels)

ENGINEERED_73 = (
    *[f"{a}_{b}_ratio" for a, b in PAIRS],
    *[f"{a}_{b}_dominance" for a, b in PAIRS],
    *[f"{a}_{b}_complementary" for a, b in COMPLEMENTARY],
    *[f"analogous_group_{i}" for i in range(1, len(ANALOGOUS) + 1)],
    "warm_colors_total", "cool_colors_total", "neutral_colors_total", "warm_cool_balance", "warm_cool_ratio",
    "num_dominant_colors", "palette_variance", "primary_dominance", "color_diversity",
    "dominant_is_warm", "dominant_is_cool", "dominant_is_neutral", "color_balance",
)


def _fields(names, kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


ART_PAGES = T.StructType(_fields(("filename", "page"), T.StringType()))
SCRAPE_RESULTS = T.StructType(_fields(("filename", "page", "image_url", "source", "status", "notes"), T.StringType()))
SCRAPE_RESULTS_DOWNLOADED = T.StructType([*SCRAPE_RESULTS.fields, *_fields(("download", "download_notes"), T.StringType())])
CRAWL_RAW = T.StructType(_fields(("page", "image", "color"), T.StringType()))
PICTURES = T.StructType([*_fields(("filename",), T.StringType()), *_fields(FEATURES_18, T.DoubleType()), *_fields(("page", "image", "color"), T.StringType()), *_fields(("index",), T.LongType())])
SHARES_12 = T.StructType([*_fields(("url",), T.StringType()), *_fields(COLOUR_NAMES, T.DoubleType())])
FEATURES_85 = T.StructType([*SHARES_12.fields, *_fields(ENGINEERED_73, T.DoubleType())])
CLUSTER_PALETTE = T.StructType([*_fields(("cluster",), T.StringType()), *_fields(COLOUR_NAMES, T.DoubleType())])
CLUSTER_CENTROIDS = T.StructType([*_fields(("cluster",), T.StringType()), *_fields(FEATURES_18, T.DoubleType())])


def require_columns(df: DataFrame, names) -> DataFrame:
    """df, or a ValueError that names the columns it lacks."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
