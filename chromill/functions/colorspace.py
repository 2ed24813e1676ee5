"""Colour spaces and colour differences as columns, from the published formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sRGB matrix, the D65 white point, and the matrix and white of the 8-bit conversion.
SRGB = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
SRGB_8 = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE_8 = (0.950456, 1.0, 1.088754)


def _linear(channel: Column) -> Column:
    c = channel.cast("double") / 255.0
    return F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92)


def with_lab(df: DataFrame, r: str = "r", g: str = "g", b: str = "b", prefix: str = "") -> DataFrame:
    """df with XYZ (x, y, z) and CIE Lab (lab_l, lab_a, lab_b) of 8-bit sRGB columns, D65; names get the prefix."""
    p = prefix
    df = df.withColumns({f"{p}lin_r": _linear(F.col(r)), f"{p}lin_g": _linear(F.col(g)), f"{p}lin_b": _linear(F.col(b))})
    lin = [F.col(f"{p}lin_{c}") for c in "rgb"]
    df = df.withColumns({f"{p}{n}": lin[0] * m[0] + lin[1] * m[1] + lin[2] * m[2] for n, m in zip("xyz", SRGB, strict=True)})
    df = df.withColumns({f"{p}f{n}": _cube(F.col(f"{p}{n}") / w) for n, w in zip("xyz", WHITE, strict=True)})
    fx, fy, fz = (F.col(f"{p}f{n}") for n in "xyz")
    df = df.withColumns({f"{p}lab_l": fy * 116.0 - 16.0, f"{p}lab_a": (fx - fy) * 500.0, f"{p}lab_b": (fy - fz) * 200.0})
    return df.drop(*[f"{p}lin_{c}" for c in "rgb"], *[f"{p}f{n}" for n in "xyz"])


def _cube(t: Column) -> Column:
    return F.when(t > 0.008856, F.pow(t, F.lit(1.0) / 3.0)).otherwise(t * 7.787 + 16.0 / 116.0)


def lab_of(rgb: tuple[int, int, int]) -> tuple[float, float, float]:
    """The same Lab for one constant colour, so that a palette's is computed once."""
    lin = [((c / 255 + 0.055) / 1.055) ** 2.4 if c / 255 > 0.04045 else c / 255 / 12.92 for c in rgb]
    f = []
    for row, white in zip(SRGB, WHITE, strict=True):
        t = sum(m * c for m, c in zip(row, lin, strict=True)) / white
        f.append(t ** (1 / 3) if t > 0.008856 else 7.787 * t + 16 / 116)
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def with_ciede2000(df: DataFrame, one: tuple[str, str, str], two: tuple[str, str, str], name: str = "delta_e") -> DataFrame:
    """df with the CIEDE2000 difference of two Lab triples. Intermediate values are staged, so no expression repeats another."""
    t = lambda n: f"__{n}"
    c = lambda n: F.col(t(n))
    l1, a1, b1 = (F.col(n) for n in one)
    l2, a2, b2 = (F.col(n) for n in two)
    stages: list[dict[str, Column]] = [
        {"c_mean": (F.sqrt(a1 * a1 + b1 * b1) + F.sqrt(a2 * a2 + b2 * b2)) / 2.0},
        {"g": (F.lit(1.0) - F.sqrt(F.pow(c("c_mean"), F.lit(7.0)) / (F.pow(c("c_mean"), F.lit(7.0)) + 25.0**7))) * 0.5},
        {"ap1": a1 * (c("g") + 1.0), "ap2": a2 * (c("g") + 1.0)},
        {"cp1": F.sqrt(c("ap1") * c("ap1") + b1 * b1), "cp2": F.sqrt(c("ap2") * c("ap2") + b2 * b2), "h1": _hue(b1, c("ap1")), "h2": _hue(b2, c("ap2"))},
        {"grey": c("cp1") * c("cp2") == 0.0, "dh": c("h2") - c("h1"), "hsum": c("h1") + c("h2")},
        {
            "dhp": F.when(c("grey"), 0.0).when(F.abs(c("dh")) <= 180.0, c("dh")).when(c("dh") > 180.0, c("dh") - 360.0).otherwise(c("dh") + 360.0),
            "hm": F.when(c("grey"), c("hsum")).when(F.abs(c("dh")) <= 180.0, c("hsum") / 2.0).when(c("hsum") < 360.0, (c("hsum") + 360.0) / 2.0).otherwise((c("hsum") - 360.0) / 2.0),
            "lm": (l1 + l2) / 2.0,
            "cm": (c("cp1") + c("cp2")) / 2.0,
        },
        {
            "dhh": F.sqrt(c("cp1") * c("cp2")) * F.sin(F.radians(c("dhp") / 2.0)) * 2.0,
            "t": F.lit(1.0) - F.cos(F.radians(c("hm") - 30.0)) * 0.17 + F.cos(F.radians(c("hm") * 2.0)) * 0.24 + F.cos(F.radians(c("hm") * 3.0 + 6.0)) * 0.32 - F.cos(F.radians(c("hm") * 4.0 - 63.0)) * 0.20,
            "theta": F.exp(-F.pow((c("hm") - 275.0) / 25.0, F.lit(2.0))) * 30.0,
            "rc": F.sqrt(F.pow(c("cm"), F.lit(7.0)) / (F.pow(c("cm"), F.lit(7.0)) + 25.0**7)) * 2.0,
            "sl": F.pow(c("lm") - 50.0, F.lit(2.0)),
        },
        {
            "dl": (l2 - l1) / (c("sl") * 0.015 / F.sqrt(c("sl") + 20.0) + 1.0),
            "dc": (c("cp2") - c("cp1")) / (c("cm") * 0.045 + 1.0),
            "dht": c("dhh") / (c("cm") * c("t") * 0.015 + 1.0),
            "rt": -F.sin(F.radians(c("theta") * 2.0)) * c("rc"),
        },
        {name: F.sqrt(F.greatest(c("dl") * c("dl") + c("dc") * c("dc") + c("dht") * c("dht") + c("rt") * c("dc") * c("dht"), F.lit(0.0)))},
    ]
    for stage in stages:
        df = df.withColumns({n if n == name else t(n): e for n, e in stage.items()})
    return df.drop(*[t(n) for stage in stages[:-1] for n in stage])


def _hue(b: Column, a: Column) -> Column:
    h = F.degrees(F.atan2(b, a))
    return F.when((a == 0.0) & (b == 0.0), 0.0).when(h < 0.0, h + 360.0).otherwise(h)


def hsv_8bit(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """8-bit hue (0 to 179), saturation and value; halves round up."""
    r, g, b = (c.cast("double") for c in (r, g, b))
    v, low = F.greatest(r, g, b), F.least(r, g, b)
    span = v - low
    hue = F.when(span == 0, 0.0).when(v == r, (g - b) * 60.0 / span).when(v == g, (b - r) * 60.0 / span + 120.0).otherwise((r - g) * 60.0 / span + 240.0)
    hue = F.floor(F.when(hue < 0, hue + 360.0).otherwise(hue) / 2.0 + 0.5)
    return {
        "h": F.when(hue >= 180, hue - 180).otherwise(hue).cast("int"),
        "s": F.floor(F.when(v == 0, 0.0).otherwise(span * 255.0 / v) + 0.5).cast("int"),
        "v": v.cast("int"),
    }


def lab_8bit(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """8-bit Lab: L times 255/100, a and b plus 128, rounded; tables of fixed-point libraries may differ by one."""
    lin = [_linear(c) for c in (r, g, b)]
    fx, fy, fz = (F.when((t := (lin[0] * m[0] + lin[1] * m[1] + lin[2] * m[2]) / w) > 0.008856, F.cbrt(t)).otherwise(t * 7.787 + 16.0 / 116.0) for m, w in zip(SRGB_8, WHITE_8, strict=True))
    y = (lin[0] * SRGB_8[1][0] + lin[1] * SRGB_8[1][1] + lin[2] * SRGB_8[1][2])
    light = F.when(y > 0.008856, F.cbrt(y) * 116.0 - 16.0).otherwise(y * 903.3)
    to8 = lambda x: F.least(F.greatest(F.floor(x + 0.5), F.lit(0)), F.lit(255)).cast("int")
    return {"lab_l8": to8(light * 255.0 / 100.0), "lab_a8": to8((fx - fy) * 500.0 + 128.0), "lab_b8": to8((fy - fz) * 200.0 + 128.0)}


def ciede2000(lab1: tuple[float, float, float], lab2: tuple[float, float, float]) -> float:
    """The same difference for two constants, for small driver-side tables."""
    (l1, a1, b1), (l2, a2, b2) = lab1, lab2
    cm = (math.hypot(a1, b1) + math.hypot(a2, b2)) / 2
    g = 0.5 * (1 - math.sqrt(cm**7 / (cm**7 + 25**7)))
    p1, p2 = a1 * (1 + g), a2 * (1 + g)
    c1, c2 = math.hypot(p1, b1), math.hypot(p2, b2)
    h1, h2 = (math.degrees(math.atan2(b, a)) % 360 if a or b else 0.0 for a, b in ((p1, b1), (p2, b2)))
    if c1 * c2 == 0:
        dh, hm = 0.0, h1 + h2
    else:
        dh = (h2 - h1 + 180) % 360 - 180 if abs(h2 - h1) > 180 else h2 - h1
        hm = (h1 + h2) / 2 if abs(h2 - h1) <= 180 else (h1 + h2 + (360 if h1 + h2 < 360 else -360)) / 2
    lm, cpm = (l1 + l2) / 2, (c1 + c2) / 2
    rad = math.radians
    t = 1 - 0.17 * math.cos(rad(hm - 30)) + 0.24 * math.cos(rad(2 * hm)) + 0.32 * math.cos(rad(3 * hm + 6)) - 0.20 * math.cos(rad(4 * hm - 63))
    dl = (l2 - l1) / (1 + 0.015 * (lm - 50) ** 2 / math.sqrt(20 + (lm - 50) ** 2))
    dc = (c2 - c1) / (1 + 0.045 * cpm)
    dhh = 2 * math.sqrt(c1 * c2) * math.sin(rad(dh / 2)) / (1 + 0.015 * cpm * t)
    rt = -math.sin(rad(60 * math.exp(-(((hm - 275) / 25) ** 2)))) * 2 * math.sqrt(cpm**7 / (cpm**7 + 25**7))
    return math.sqrt(max(0.0, dl * dl + dc * dc + dhh * dhh + rt * dc * dhh))
