import numpy as np
import pytest
from pyspark.sql import functions as F

from chromill.functions.colorspace import ciede2000, hsv_8bit, lab_8bit, lab_of, with_ciede2000
from chromill.operators import engineered as e
from chromill.operators import palette, pixels
from chromill.schemas import COLOUR_NAMES, COLOURS, ENGINEERED_73, FEATURES_18


def rgb(spark, *colours):
    return spark.createDataFrame(list(colours), "r int, g int, b int")


def test_orders():
    assert len(ENGINEERED_73) == 73 and len(FEATURES_18) == 18
    assert FEATURES_18[:4] == ("b_bgr_mean", "g_bgr_mean", "r_bgr_mean", "h_hsv_mean") and FEATURES_18[9] == "b_bgr_std"
    assert list(COLOUR_NAMES) == sorted(COLOUR_NAMES)
    assert ENGINEERED_73[60:] == (
        "warm_colors_total", "cool_colors_total", "neutral_colors_total", "warm_cool_balance", "warm_cool_ratio", "num_dominant_colors", "palette_variance",
        "primary_dominance", "color_diversity", "dominant_is_warm", "dominant_is_cool", "dominant_is_neutral", "color_balance",
    )


@pytest.mark.parametrize(("a", "b", "de"), [("red", "orange", 33.7521), ("black", "white", 100.0), ("blue", "purple", 19.8424), ("grey", "white", 33.2390), ("pink", "red", 34.9327), ("green", "turquoise", 37.6731)])
def test_differences_of_basic_colours(a, b, de):
    assert ciede2000(lab_of(COLOURS[a]), lab_of(COLOURS[b])) == pytest.approx(de, abs=1e-4)
    assert ciede2000(lab_of(COLOURS[a]), lab_of(COLOURS[a])) == 0


def test_published_pair(spark):
    df = spark.createDataFrame([(50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485)], "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double")
    there = with_ciede2000(df, ("l1", "a1", "b1"), ("l2", "a2", "b2")).first()["delta_e"]
    back = with_ciede2000(df, ("l2", "a2", "b2"), ("l1", "a1", "b1")).first()["delta_e"]
    assert there == pytest.approx(2.0425, abs=1e-4) and there == pytest.approx(back)


def test_nearest_basic_colour(spark):
    want = {(12, 10, 10): "black", (200, 30, 40): "red", (90, 60, 30): "brown", (250, 128, 114): "red", (0, 0, 139): "blue", (245, 245, 220): "white", (70, 130, 180): "grey", (154, 205, 50): "yellow"}
    found = palette.nearest_basic(rgb(spark, *want)).collect()
    assert {(r.r, r.g, r.b): r.name for r in found} == want


def test_8bit_spaces(spark):
    want = {(255, 0, 0): (0, 255, 255, 136, 208, 195), (0, 255, 0): (60, 255, 255, 224, 42, 211), (0, 0, 255): (120, 255, 255, 82, 207, 20), (200, 30, 40): (178, 217, 200, 110, 191, 168), (70, 130, 180): (104, 156, 180, 134, 124, 96), (255, 255, 255): (0, 0, 255, 255, 128, 128), (0, 0, 0): (0, 0, 0, 0, 128, 128)}
    c = [F.col(x) for x in "rgb"]
    for r in rgb(spark, *want).select("r", "g", "b", *[x.alias(n) for n, x in (hsv_8bit(*c) | lab_8bit(*c)).items()]).collect():
        assert all(abs(x - y) <= 1 for x, y in zip(tuple(r)[3:], want[(r.r, r.g, r.b)], strict=True)), r


def shares(spark, **given):
    return spark.createDataFrame([("u", *[float(given.get(c, 0)) for c in COLOUR_NAMES])], "url string, " + ", ".join(f"{c} double" for c in COLOUR_NAMES))


def test_engineered_golden_rows(spark):
    names = ["red_blue_ratio", "black_white_ratio", "warm_colors_total", "cool_colors_total", "neutral_colors_total", "warm_cool_balance", "warm_cool_ratio", "num_dominant_colors", "color_diversity", "palette_variance", "color_balance"]
    cases = [
        ({c: 1 / 12 for c in COLOUR_NAMES}, [0.988142, 0.988142, 1 / 3, 1 / 3, 0.25, 0, 0.997009, 0, 12, 0, 1]),
        ({"red": 1.0}, [1000, 0, 1, 0, 0, 1, 1000, 1, 1, 0.276385, 0.723615]),
        ({"black": 0.3, "blue": 0.12, "brown": 0.15, "orange": 0.11, "red": 0.12, "white": 0.2}, [0.991736, 1.492537, 0.38, 0.12, 0.5, 0.26, 3.140496, 6, 6, 0.095772, 0.904228]),
        ({"pink": 0.6, "grey": 0.4}, [0, 0, 0, 0, 0.4, 0, 0, 2, 2, 0.190759, 0.809241]),
    ]
    for given, want in cases:
        r = e.features_85(shares(spark, **given)).first()
        assert [r[n] for n in names] == pytest.approx(want, abs=1e-6)
    assert tuple(r[f"dominant_is_{t}"] for t in ("warm", "cool", "neutral")) == (0, 0, 0)


def test_smoothing(spark):
    r = e.smooth(shares(spark, red=0.5, blue=0.5)).first()
    assert r.red == pytest.approx(0.495) and r.green == pytest.approx(0.001)
    r = e.smooth(shares(spark)).first()
    assert all(r[c] == pytest.approx((1 / 12) * 0.988 + 0.001) for c in COLOUR_NAMES)
    assert e.smooth(shares(spark, red=1)).first().red == pytest.approx(0.989)


def test_validation_counts(spark):
    f = e.features_85(shares(spark, red=1))
    assert {r.colour: r.violations for r in e.validation(f).collect()} == {c: 1 for c in COLOUR_NAMES}
    assert all(r.violations == 0 for r in e.binary_violations(f).collect())
    with pytest.raises(ValueError, match="missing columns: yellow"):
        e.features_85(shares(spark).drop("yellow"))


def test_image_features_and_dominant_colours(spark):
    px = spark.createDataFrame([(1, 255, 0, 0)] * 30 + [(1, 0, 0, 255)] * 10 + [(2, 5, 5, 5)] * 4, "image_id int, r int, g int, b int")
    f = {r.image_id: r for r in pixels.image_features(px).collect()}
    assert f[1].r_bgr_mean == pytest.approx(191.25) and f[2].r_bgr_std == 0
    dom = palette.dominant_colours(px, k=5)
    assert {(r.image_id, r.r, r.b): round(r.share, 6) for r in dom.collect()} == {(1, 255, 0): 0.75, (1, 0, 255): 0.25}
    basic = palette.basic_shares(dom.selectExpr("string(image_id) url", "r", "g", "b", "share")).first()
    assert basic.red == pytest.approx(0.75 * 0.988 + 0.001)


def test_percent_strings(spark):
    df = spark.createDataFrame([("56.55%", None), ("x", "1%")], "black string, blue string")
    assert [tuple(r) for r in palette.parse_percent(df, ("black", "blue")).collect()] == [(pytest.approx(0.5655), None), (None, pytest.approx(0.01))]


def test_starts_that_go_together_end_as_each_alone():
    points = np.random.default_rng(3).integers(0, 256, (300, 3)).astype(float)
    seeds = palette.kmeans_plus_plus(points, 12, 4, np.random.default_rng(7))
    ends = []
    for centres in seeds:
        for _ in range(50):
            label = ((points[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
            moved = np.array([points[label == i].mean(0) if (label == i).any() else centres[i] for i in range(12)])
            if np.allclose(moved, centres):
                break
            centres = moved
        ends.append((((points - centres[label]) ** 2).sum(), centres))
    assert np.allclose(palette._lloyd(points, 12, 7, 4), min(ends, key=lambda x: x[0])[1])
    assert len(np.unique(seeds[0], axis=0)) == 12 and palette._lloyd(points[:1].repeat(3, 0), 2, 7, 2).shape == (2, 3)


def test_dominant_colours_are_computed_once_for_shares(spark):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([("a", 250, 0, 0, 0.5), ("a", 0, 0, 250, 0.5), ("b", 0, 0, 0, 1.0)], "url string, r int, g int, b int, share double")
    assert palette.basic_shares(rows.mapInArrow(counted, rows.schema)).count() == 2
    assert runs.value == 3
