"""Catalogue of the colour operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.colorspace import SRGB_8, WHITE_8, hsv_8bit, lab_8bit, lab_of, with_lab
from ..operators import engineered as e
from ..operators import palette, pixels
from ..schemas import ANALOGOUS, COLOUR_NAMES, COLOURS, COMPLEMENTARY, COOL, NEUTRAL, PAIRS, PRIMARY, WARM
from . import derived as d


def _rounded(columns: dict, places: int = 6) -> list:
    return [F.round(c, places).alias(n) for n, c in columns.items()]


def q_palette_temperature(spark, sf_dir):
    """Artworks and mean warm-cool balance for each dominant temperature."""
    shares = e.smooth(d.pal12(spark, sf_dir))
    temperature = e.dominant_temperature(e.dominant_colour())
    typed = shares.select(temperature.alias("temperature"), e.temperature()["warm_cool_balance"].alias("balance"))
    return typed.groupBy("temperature").agg(F.count("*").alias("n_artworks"), F.round(F.avg("balance"), 6).alias("avg_balance"))


def q_engineered_ratios(spark, sf_dir):
    """I7"""
    return d.pal12(spark, sf_dir).select("url", *_rounded(e.ratios()))


def q_engineered_dominance(spark, sf_dir):
    """I8"""
    return d.pal12(spark, sf_dir).select("url", *[c.alias(n) for n, c in e.dominance().items()])


def q_engineered_harmony(spark, sf_dir):
    """I9, I10"""
    return d.pal12(spark, sf_dir).select("url", *[c.alias(n) for n, c in e.harmony().items()])


def q_engineered_balance(spark, sf_dir):
    """I11, I12"""
    return d.pal12(spark, sf_dir).select("url", *_rounded(e.temperature() | e.diversity()))


def q_engineered_dominant(spark, sf_dir):
    """F4, I13"""
    return d.pal12(spark, sf_dir).select("url", e.dominant_colour().alias("dominant"), *[c.alias(n) for n, c in e.dominant_flags().items()])


def q_engineered_validation(spark, sf_dir):
    """I35, E12"""
    found = e.validation(e.features_85(e.smooth(d.pal12(spark, sf_dir))))
    return found.select("colour", "violations", *[F.round(c, 6).alias(c) for c in ("min_share", "max_share", "avg_share", "std_share")])


def q_palette_smoothing(spark, sf_dir):
    """I5, E5"""
    smoothed = e.smooth(d.pal12(spark, sf_dir))
    return smoothed.select("url", *[F.round(c, 6).alias(c) for c in COLOUR_NAMES], F.round(sum((F.col(c) for c in COLOUR_NAMES[1:]), F.col(COLOUR_NAMES[0])), 6).alias("total"))


def q_pixel_lab(spark, sf_dir):
    """I1, I2, I3"""
    lab = with_lab(d.colours(spark, sf_dir))
    return lab.select("r", "g", "b", *[F.round(c, 4).alias(c) for c in ("x", "y", "z", "lab_l", "lab_a", "lab_b")])


def q_ciede2000_pairs(spark, sf_dir):
    """I4, D4"""
    return palette.colour_differences(d.colours(spark, sf_dir)).select("r", "g", "b", "name", F.round("delta_e", 4).alias("delta_e"))


def q_nearest_basic_colour(spark, sf_dir):
    """D4"""
    return palette.nearest_basic(d.colours(spark, sf_dir)).select("r", "g", "b", "name")


def q_colour_share_pivot(spark, sf_dir):
    """E3, E4, E5"""
    p = d.pixels(spark, sf_dir).select("image_id", *[(F.col(c) - F.col(c) % 32).alias(c) for c in "rgb"])
    return palette.shares_by_image(p).select("image_id", *[F.round(c, 6).alias(c) for c in COLOUR_NAMES])


def q_pixel_hsv(spark, sf_dir):
    """I14"""
    p = d.pixels(spark, sf_dir).select("r", "g", "b").distinct()
    return p.select("r", "g", "b", *[c.alias(n) for n, c in hsv_8bit(F.col("r"), F.col("g"), F.col("b")).items()])


def q_pixel_lab8(spark, sf_dir):
    """I15"""
    p = d.pixels(spark, sf_dir).select("r", "g", "b").distinct()
    return p.select("r", "g", "b", *[c.alias(n) for n, c in lab_8bit(F.col("r"), F.col("g"), F.col("b")).items()])


def q_image_features_lab(spark, sf_dir):
    """E1, E2, I16"""
    f = pixels.image_features(d.pixels(spark, sf_dir))
    return f.select("image_id", *[F.round(c, 6).alias(c) for c in f.columns if "_lab_" in c])


def q_image_features_bgr(spark, sf_dir):
    """E1, E2"""
    f = pixels.image_features(d.pixels(spark, sf_dir))
    return f.select("image_id", *[F.round(c, 6).alias(c) for c in f.columns if "_bgr_" in c or "_hsv_" in c])


def q_unique_pixels(spark, sf_dir):
    """E28"""
    return pixels.unique_pixels(d.pixels(spark, sf_dir))


def r_dominant_colours(spark, sf_dir):
    """K-means over each image's pixels, without SQL."""
    return palette.dominant_colours(d.pixels(spark, sf_dir), starts=10)


def r_image_palettes(spark, sf_dir):
    """Smoothed shares of basic colours from each image's dominant colours."""
    return palette.basic_shares(r_dominant_colours(spark, sf_dir).select(F.concat(F.lit("img_"), F.col("image_id").cast("string")).alias("url"), "r", "g", "b", "share"))


QUERIES = [
    q_palette_temperature, q_engineered_ratios, q_engineered_dominance, q_engineered_harmony, q_engineered_balance, q_engineered_dominant, q_engineered_validation,
    q_palette_smoothing, q_pixel_lab, q_ciede2000_pairs, q_nearest_basic_colour, q_colour_share_pivot, q_pixel_hsv, q_pixel_lab8, q_image_features_bgr, q_image_features_lab, q_unique_pixels, r_dominant_colours, r_image_palettes,
]

_names = ", ".join(f"'{c}'" for c in COLOUR_NAMES)
_list = "[" + ", ".join(COLOUR_NAMES) + "]"
_sum = lambda names: " + ".join(names)
_flag = lambda cond: f"case when {cond} then 1.0::double else 0.0::double end"
_in = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_SMOOTH = f"sums as (select *, {_sum(COLOUR_NAMES)} as total from pal12), smoothed as (select url, label, {', '.join(f'least(greatest((case when total > 0 then {c} / total else 1.0::double / 12 end) * 0.988::double + 0.001::double, 0.001::double), 0.999::double) as {c}' for c in COLOUR_NAMES)} from sums)"
_DOMINANT = f"[{_names}][list_position({_list}, list_max({_list}))]"
_TEMPERATURE = f"case when {{x}} in {_in(WARM)} then 'warm' when {{x}} in {_in(COOL)} then 'cool' when {{x}} in {_in(NEUTRAL)} then 'neutral' else 'none' end"
_warm, _cool = f"({_sum(WARM)})", f"({_sum(COOL)})"
_mean = f"(({_sum(COLOUR_NAMES)}) / 12.0::double)"
_spread = "sqrt((" + " + ".join(f"({c} - {_mean}) * ({c} - {_mean})" for c in COLOUR_NAMES) + ") / 12.0::double)"

_LIN = ", ".join(f"case when {c} / 255.0::double > 0.04045::double then pow(({c} / 255.0::double + 0.055::double) / 1.055::double, 2.4::double) else {c} / 255.0::double / 12.92::double end as lin_{c}" for c in "rgb")
_XYZ = ", ".join(f"lin_r * {m[0]}::double + lin_g * {m[1]}::double + lin_b * {m[2]}::double as {n}" for n, m in zip("xyz", ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041)), strict=True))
_F = ", ".join(f"case when {n} / {w}::double > 0.008856::double then pow({n} / {w}::double, 1.0::double / 3) else 7.787::double * ({n} / {w}::double) + 16.0::double / 116 end as f{n}" for n, w in zip("xyz", (0.95047, 1.0, 1.08883), strict=True))
_LAB = f"{d.COLOURS_SQL}, lin as (select r, g, b, {_LIN} from colours), xyz as (select r, g, b, {_XYZ} from lin), fxyz as (select *, {_F} from xyz), lab as (select r, g, b, x, y, z, 116.0::double * fy - 16.0::double as lab_l, 500.0::double * (fx - fy) as lab_a, 200.0::double * (fy - fz) as lab_b from fxyz)"
_PALETTE = "palette as (select * from (values " + ", ".join(f"({i}, '{n}', {lab_of(rgb)[0]!r}::double, {lab_of(rgb)[1]!r}::double, {lab_of(rgb)[2]!r}::double)" for i, (n, rgb) in enumerate(COLOURS.items())) + ") p(ord, name, p_l, p_a, p_b))"
_DE = f"""{_LAB}, {_PALETTE},
s1 as (select *, (sqrt(lab_a * lab_a + lab_b * lab_b) + sqrt(p_a * p_a + p_b * p_b)) / 2 as c_mean from lab cross join palette),
s2 as (select *, 0.5::double * (1 - sqrt(pow(c_mean, 7) / (pow(c_mean, 7) + pow(25.0::double, 7)))) as gg from s1),
s3 as (select *, lab_a * (1 + gg) as a1, p_a * (1 + gg) as a2 from s2),
s4 as (select *, sqrt(a1 * a1 + lab_b * lab_b) as c1, sqrt(a2 * a2 + p_b * p_b) as c2, degrees(atan2(lab_b, a1)) as t1, degrees(atan2(p_b, a2)) as t2 from s3),
s5 as (select *, case when a1 = 0 and lab_b = 0 then 0.0::double when t1 < 0 then t1 + 360 else t1 end as h1, case when a2 = 0 and p_b = 0 then 0.0::double when t2 < 0 then t2 + 360 else t2 end as h2 from s4),
s6 as (select *, case when c1 * c2 = 0 then 0.0::double when abs(h2 - h1) <= 180 then h2 - h1 when h2 - h1 > 180 then h2 - h1 - 360 else h2 - h1 + 360 end as dh,
  case when c1 * c2 = 0 then h1 + h2 when abs(h2 - h1) <= 180 then (h1 + h2) / 2 when h1 + h2 < 360 then (h1 + h2 + 360) / 2 else (h1 + h2 - 360) / 2 end as hm, (lab_l + p_l) / 2 as lm, (c1 + c2) / 2 as cm from s5),
s7 as (select *, 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) as dhh, 1 - 0.17::double * cos(radians(hm - 30)) + 0.24::double * cos(radians(2 * hm)) + 0.32::double * cos(radians(3 * hm + 6)) - 0.20::double * cos(radians(4 * hm - 63)) as t,
  30 * exp(-pow((hm - 275) / 25, 2)) as theta, 2 * sqrt(pow(cm, 7) / (pow(cm, 7) + pow(25.0::double, 7))) as rc from s6),
s8 as (select *, (p_l - lab_l) / (1 + 0.015::double * pow(lm - 50, 2) / sqrt(20 + pow(lm - 50, 2))) as dl, (c2 - c1) / (1 + 0.045::double * cm) as dc, dhh / (1 + 0.015::double * cm * t) as dhn, -sin(radians(2 * theta)) * rc as rt from s7),
de as (select r, g, b, ord, name, sqrt(greatest(dl * dl + dc * dc + dhn * dhn + rt * dc * dhn, 0.0::double)) as delta_e from s8)"""
_NEAREST = "nearest as (select r, g, b, name from de qualify row_number() over (partition by r, g, b order by round(delta_e, 9), ord) = 1)"
_V, _M = "greatest(r, g, b)", "least(r, g, b)"
_HUE = f"case when {_V} = {_M} then 0.0::double when {_V} = r then (g - b) * 60.0::double / ({_V} - {_M}) when {_V} = g then (b - r) * 60.0::double / ({_V} - {_M}) + 120 else (r - g) * 60.0::double / ({_V} - {_M}) + 240 end"
_HSV = f"hue as (select *, {_HUE} as deg from {{src}}), h2 as (select *, floor(case when deg < 0 then deg + 360 else deg end / 2 + 0.5::double) as hh from hue), hsv as (select * exclude (deg, hh), cast(case when hh >= 180 then hh - 180 else hh end as integer) as h, cast(floor(case when {_V} = 0 then 0.0::double else ({_V} - {_M}) * 255.0::double / {_V} end + 0.5::double) as integer) as s, {_V} as v from h2)"

_XYZ8 = ", ".join(f"(lin_r * {m[0]}::double + lin_g * {m[1]}::double + lin_b * {m[2]}::double) / {w}::double as {n}" for n, m, w in zip("xyz", SRGB_8, WHITE_8, strict=True))
_F8 = ", ".join(f"case when {n} > 0.008856::double then cbrt({n}) else {n} * 7.787::double + 16.0::double / 116.0::double end as f{n}" for n in "xyz")
_to8 = lambda e: f"cast(least(greatest(floor({e} + 0.5::double), 0), 255) as integer)"
_LAB8 = f"""{d.PIXELS}, seen as (select distinct r, g, b from pixels), lin8 as (select r, g, b, {_LIN} from seen), xyz8 as (select r, g, b, {_XYZ8} from lin8), f8 as (select *, {_F8} from xyz8),
 lab8 as (select r, g, b, {_to8("(case when y > 0.008856::double then cbrt(y) * 116.0::double - 16.0::double else y * 903.3::double end) * 255.0::double / 100.0::double")} as lab_l8,
 {_to8("(fx - fy) * 500.0::double + 128.0::double")} as lab_a8, {_to8("(fy - fz) * 200.0::double + 128.0::double")} as lab_b8 from f8)"""
_STATS8 = ", ".join(f"round({fn}({c}), 6) as {n}_lab_{stat}" for stat, fn in (("mean", "avg"), ("std", "stddev_pop")) for n, c in (("l", "lab_l8"), ("a", "lab_a8"), ("b", "lab_b8")))

SQL = {
    "q_pixel_lab8": f"with {_LAB8} select r, g, b, lab_l8, lab_a8, lab_b8 from lab8",
    "q_image_features_lab": f"with {_LAB8} select image_id, {_STATS8} from pixels join lab8 using (r, g, b) group by image_id",
    "q_palette_temperature": f"with {d.PAL12}, {_SMOOTH}, typed as (select {_TEMPERATURE.format(x=_DOMINANT)} as temperature, abs({_warm} - {_cool}) as balance from smoothed) select temperature, count(*) as n_artworks, round(avg(balance), 6) as avg_balance from typed group by 1",
    "q_engineered_ratios": f"with {d.PAL12} select url, {', '.join(f'round({a} / ({b} + 0.001::double), 6) as {a}_{b}_ratio' for a, b in PAIRS)} from pal12",
    "q_engineered_dominance": f"with {d.PAL12} select url, {', '.join(_flag(f'{a} > {b}') + f' as {a}_{b}_dominance' for a, b in PAIRS)} from pal12",
    "q_engineered_harmony": f"with {d.PAL12} select url, {', '.join(_flag(f'{a} > 0.1::double and {b} > 0.1::double') + f' as {a}_{b}_complementary' for a, b in COMPLEMENTARY)}, {', '.join(_flag(' and '.join(f'{x} > 0.05::double' for x in g)) + f' as analogous_group_{i}' for i, g in enumerate(ANALOGOUS, 1))} from pal12",
    "q_engineered_balance": f"""with {d.PAL12} select url, round({_warm}, 6) as warm_colors_total, round({_cool}, 6) as cool_colors_total, round({_sum(NEUTRAL)}, 6) as neutral_colors_total, round(abs({_warm} - {_cool}), 6) as warm_cool_balance, round({_warm} / ({_cool} + 0.001::double), 6) as warm_cool_ratio,
      round(cast(len(list_filter({_list}, lambda x: x > 0.1::double)) as double), 6) as num_dominant_colors, round({_spread}, 6) as palette_variance, round({_sum(PRIMARY)}, 6) as primary_dominance, round(cast(len(list_filter({_list}, lambda x: x > 0.05::double)) as double), 6) as color_diversity, round(1 - {_spread}, 6) as color_balance from pal12""",
    "q_engineered_dominant": f"with {d.PAL12}, n as (select url, {_DOMINANT} as dominant from pal12) select url, dominant, {_flag(f'dominant in {_in(WARM)}')} as dominant_is_warm, {_flag(f'dominant in {_in(COOL)}')} as dominant_is_cool, {_flag(f'dominant in {_in(NEUTRAL)}')} as dominant_is_neutral from n",
    "q_engineered_validation": f"with {d.PAL12}, {_SMOOTH}, long as (unpivot (select {', '.join(COLOUR_NAMES)} from smoothed) on {', '.join(COLOUR_NAMES)} into name colour value share) select colour, count(*) filter (where share <= 0 or share >= 1) as violations, round(min(share), 6) as min_share, round(max(share), 6) as max_share, round(avg(share), 6) as avg_share, round(stddev_pop(share), 6) as std_share from long group by colour",
    "q_palette_smoothing": f"with {d.PAL12}, {_SMOOTH} select url, {', '.join(f'round({c}, 6) as {c}' for c in COLOUR_NAMES)}, round({_sum(COLOUR_NAMES)}, 6) as total from smoothed",
    "q_pixel_lab": f"with {_LAB} select r, g, b, {', '.join(f'round({c}, 4) as {c}' for c in ('x', 'y', 'z', 'lab_l', 'lab_a', 'lab_b'))} from lab",
    "q_ciede2000_pairs": f"with {_DE} select r, g, b, name, round(delta_e, 4) as delta_e from de",
    "q_nearest_basic_colour": f"with {_DE}, {_NEAREST} select r, g, b, name from nearest",
    "q_colour_share_pivot": f"with {_DE}, {_NEAREST}, low as (select image_id, r - r % 32 as r, g - g % 32 as g, b - b % 32 as b from pixels) select image_id, {', '.join(f"round(count(*) filter (where name = '{c}') / cast(count(*) as double), 6) as {c}" for c in COLOUR_NAMES)} from low join nearest using (r, g, b) group by image_id",
    "q_pixel_hsv": f"with {d.PIXELS}, p as (select distinct r, g, b from pixels), {_HSV.format(src='p')} select r, g, b, h, s, v from hsv",
    "q_image_features_bgr": f"with {d.PIXELS}, {_HSV.format(src='pixels')} select image_id, {', '.join(f'round(avg({c}), 6) as {c}_{sp}_mean, round(stddev_pop({c}), 6) as {c}_{sp}_std' for sp in ('bgr', 'hsv') for c in sp)} from hsv group by image_id",
    "q_unique_pixels": f"with {d.PIXELS} select image_id, count(distinct (r, g, b)) as n_unique from pixels group by image_id",
}
