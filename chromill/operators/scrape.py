"""Image URLs from pages: the cascade, the status of each row, and what a crawl resumes from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as h
from ..functions.urls import join_url
from ..schemas import require_columns
from ..session import fixed
from .ordering import ranks

#: Images of no more pixels than this are icons.
MIN_AREA = 10_000


def clean_crawl(raw: DataFrame, order: str = "pos") -> DataFrame:
    """Crawl rows with an image: 'index' numbers the rows before the filter, image loses its url("...") and filename is the key.

    'none' marks a row without an image; a null image is kept, as it is not the mark.
    """
    numbered = raw.withColumn("index", F.col(order).cast("long"))
    kept = numbered.where(~F.col("image").eqNullSafe("none"))
    image = F.try_element_at(F.split("image", '"'), F.lit(2))
    return kept.withColumn("image", image).withColumn("filename", F.concat(F.col("index").cast("string"), F.lit(".jpg")))


def image_tags(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, src, width, height) of every img tag outside comments and scripts that has a source.

    src falls back to data-src; dimensions are null where unknown; pos counts the tags without a source too.
    """
    t = F.col("tag")
    src = F.coalesce(F.nullif(h.attribute(t, "src"), F.lit("")), h.attribute(t, "data-src"))
    exploded = pages.select(key, F.posexplode(h.tags(h.visible(F.col("html")), "img")).alias("pos", "tag"))
    sourced = exploded.select(key, "pos", src.alias("src"), h.dimension(h.attribute(t, "width")).alias("width"), h.dimension(h.attribute(t, "height")).alias("height"))
    return sourced.where(F.col("src") != "").withColumn("src", h.decoded("src"))


def largest_image(tag_rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Per page the image of most pixels, above MIN_AREA, the first of equals; without one, the first that lacks a dimension."""
    area = F.coalesce(F.col("width").cast("long") * F.col("height"), F.lit(0))
    sized = tag_rows.withColumn("area", area)
    rank = F.when(F.col("area") > MIN_AREA, F.struct(F.lit(0).alias("k"), (-F.col("area")).alias("a"), F.col("pos").alias("p"))).when(F.col("area") == 0, F.struct(F.lit(1).alias("k"), F.lit(0).cast("long").alias("a"), F.col("pos").alias("p")))
    return sized.withColumn("rank", rank).where("rank IS NOT NULL").groupBy(key).agg(F.min_by(F.struct("src", "area"), "rank").alias("best")).select(key, "best.src", "best.area")


def _images(html: Column) -> Column:
    """Of each img tag that has a source: area (0 where a dimension is unknown), how far back it stands, src."""
    def read(t: Column, i: Column) -> Column:
        area = F.coalesce(h.dimension(h.attribute(t, "width")).cast("long") * h.dimension(h.attribute(t, "height")), F.lit(0))
        return F.struct(area.alias("area"), (-i).alias("back"), F.coalesce(F.nullif(h.attribute(t, "src"), F.lit("")), h.attribute(t, "data-src")).alias("src"))

    return F.filter(F.transform(h.tags(html, "img"), read), lambda x: x.src != "")


def extract_images(pages: DataFrame, exact_json: bool = True) -> DataFrame:
    """pages (page, html) with image_url and source, by the cascade og:image, twitter:image, JSON-LD, largest img, none.

    Comments count for nothing, nor do tags inside scripts; the character references of the chosen attribute are
    resolved. exact_json reads JSON-LD in document order by a parser in Arrow batches; otherwise the three plain forms
    of a top-level image (string, object with url, list of either) are read by Spark's JSON functions alone.
    """
    page = F.col("page")
    some = lambda c: F.when(F.length(c) > 0, c)
    staged = pages.withColumn("__tags", h.visible(F.col("html")))
    staged = staged.withColumns({"__og": some(h.first_meta(F.col("__tags"), "property", "og:image")), "__tw": some(h.first_meta(F.col("__tags"), "name", "twitter:image")), "__ld": h.json_ld(h.visible(F.col("html"), bodies=True)), "__all": _images(F.col("__tags"))})
    # the largest, the first of equals; else the first that lacks a dimension
    best = F.coalesce(F.array_max(F.filter("__all", lambda x: x.area > MIN_AREA)), F.array_max(F.filter("__all", lambda x: x.area == 0)))
    staged = staged.withColumn("__img", some(best.src))
    if exact_json:
        ld = h.json_ld_image(F.col("__ld"))
    else:
        forms = ("$.image.url", "$.image[0].url", "$.image[0]", "$.image")
        plain = lambda s: F.coalesce(*[F.when(~F.get_json_object(s, f).rlike(r"^[\[{]"), F.get_json_object(s, f)) for f in forms])
        ld = F.get(F.filter(F.transform("__ld", plain), lambda x: x.isNotNull() & (x != "")), 0)
    staged = staged.withColumn("__ldimg", some(ld))
    pick = F.coalesce(*[F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("url"), F.lit(s).alias("source"))) for c, s in (("__og", "og:image"), ("__tw", "twitter:image"), ("__ldimg", "jsonld"), ("__img", "fallback:img"))])
    picked = staged.withColumn("__pick", pick).withColumn("__url", h.decoded(F.when(F.col("__pick.source") != "jsonld", F.col("__pick.url"))))
    out = picked.withColumns({"image_url": join_url(page, F.coalesce("__url", "__pick.url")), "source": F.coalesce("__pick.source", F.lit("none_found"))})
    return out.drop("__tags", "__og", "__tw", "__ld", "__all", "__img", "__ldimg", "__pick", "__url")


def verify_status(head: Column, get: Column, error: Column, robust: bool = False) -> Column:
    """(status, notes) of an image's check: HEAD, and GET where HEAD is not allowed."""
    out = lambda s, n: F.struct(F.lit(s).alias("status"), (n if isinstance(n, Column) else F.lit(n)).alias("notes"))
    rate = F.when(head == 429, out("ok", "rate limited (429) but likely valid")) if robust else F.when(F.lit(False), out("ok", ""))
    return (
        F.when(error.isNotNull(), out("error", F.concat(F.lit("verify_failed: "), error)))
        .when(head == 200, out("ok", ""))
        .when(head == 403, out("ok", "HEAD returned 403 but image likely valid"))
        .otherwise(F.coalesce(rate, F.when(head == 405, F.when(get == 200, out("ok", "")).otherwise(out("error", F.concat(F.lit("HTTP "), get.cast("string"))))), out("error", F.concat(F.lit("HTTP "), head.cast("string")))))
    )


def row_status(rows: DataFrame, robust: bool = False) -> DataFrame:
    """filename, page, image_url, source, status, notes from (filename, page, fetch_error, image_url, source, head, get, verify_error)."""
    verified = verify_status(F.col("head"), F.col("get"), F.col("verify_error"), robust)
    state = (
        F.when(F.coalesce(F.trim("page"), F.lit("")) == "", F.struct(F.lit("error").alias("status"), F.lit("empty_page_url").alias("notes")))
        .when(F.col("fetch_error").isNotNull(), F.struct(F.lit("error").alias("status"), F.concat(F.lit("page_fetch_failed: "), "fetch_error").alias("notes")))
        .when(F.coalesce(F.col("image_url"), F.lit("")) == "", F.struct(F.lit("error").alias("status"), F.lit("no_image_found").alias("notes")))
        .otherwise(verified)
    )
    blank = F.col("state.notes").isin("empty_page_url") | F.col("fetch_error").isNotNull()
    staged = rows.withColumn("state", state)
    return staged.select("filename", "page", F.when(blank, "").otherwise(F.coalesce("image_url", F.lit(""))).alias("image_url"), F.when(blank, "").otherwise(F.coalesce("source", F.lit(""))).alias("source"), "state.status", "state.notes")


def success_rate(results: DataFrame, by: str | None = None) -> DataFrame:
    """Rows, rows with status ok and their percentage; null where there are none."""
    ok = F.count_if(F.col("status") == "ok")
    grouped = results.groupBy(by) if by else results.groupBy()
    return grouped.agg(F.count("*").alias("n"), ok.alias("n_ok"), F.try_divide(ok * F.lit(100.0), F.count("*").cast("double")).alias("rate"))


def remaining(rows: DataFrame, prior: DataFrame | None, key: str = "filename", retry_errors: bool = False) -> DataFrame:
    """Rows whose key prior output lacks; with retry_errors, prior errors count as missing. Null keys remain."""
    require_columns(rows, (key,))
    if prior is None:
        return rows
    if retry_errors:
        prior = prior.where("status = 'ok'")
    return rows.join(prior.select(key).distinct(), key, "left_anti")


def from_key(rows: DataFrame, key: str, start: str, pos: str = "pos") -> DataFrame:
    """Rows from the first with the key on, by position; all where none has it."""
    first = rows.where(F.col(key) == start).agg(F.coalesce(F.min(pos), F.lit(0)).alias("__first"))
    return rows.join(F.broadcast(first)).where(F.col(pos) >= F.col("__first")).drop("__first")  # first is one row


def until_key(rows: DataFrame, key: str, stop: str, pos: str = "pos") -> DataFrame:
    """Rows strictly before the first with the key; all where none has it."""
    first = rows.where(F.col(key) == stop).agg(F.coalesce(F.min(pos), F.lit(2**63 - 1)).alias("__first"))
    return rows.join(F.broadcast(first)).where(F.col(pos) < F.col("__first")).drop("__first")


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in order. min_by combines before the shuffle, unlike a window."""
    columns = rows.columns
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("__row"))
    return best.select("__row.*")


def batch_numbers(rows: DataFrame, order: list[Column], size: int, existing: int = 0) -> DataFrame:
    """rows with pos (from 1) and batch, numbered on from the existing ones.

    The order is over all rows; ranks come from a range partition and the counts before each. The range
    partition is written to the checkpoint folder, so that counts and rows agree after a lost executor.
    """
    placed = ranks(rows, order).withColumn("pos", F.col("__rank") + 1).drop("__rank")
    return placed.withColumn("batch", F.floor((F.col("pos") - 1) / size) + 1 + existing)


def batch_size(n: int, batches: int = 100) -> int:
    """Rows of a batch: n in about so many batches, one more where it does not come out even."""
    size = max(1, n // batches)
    return size + 1 if n % batches else size


def backoff(attempts: DataFrame, host: str = "host", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Per host the back-off after all its attempts in order: times 0.9 after 200 (0.5 at least), times 1.5 after 429 (5 at most).

    A step, and any run of steps, is a factor held between two bounds; so each range of a host's attempts
    is folded into one (factor, low, high), and a host's ranges are folded in turn. No task holds a host's whole history.
    """
    ranged = fixed(attempts.select(host, *order, "status").repartitionByRange(host, *order).withColumn("__part", F.spark_partition_id()))
    runs = ranged.groupBy(host, "__part").agg(F.array_sort(F.collect_list(F.struct(*order, "status"))).alias("runs"))
    number = lambda x: F.lit(float(x))

    def after(a: Column, factor: Column, low: Column, high: Column) -> Column:
        held = lambda x: F.least(F.greatest(x * factor, low), high)
        return F.struct((a.factor * factor).alias("factor"), held(a.low).alias("low"), held(a.high).alias("high"))

    def step(a: Column, x: Column) -> Column:
        return F.when(x.status == 200, after(a, number(0.9), number(0.5), number("inf"))).when(x.status == 429, after(a, number(1.5), number("-inf"), number(5.0))).otherwise(a)

    whole = F.struct(number(1.0).alias("factor"), number("-inf").alias("low"), number("inf").alias("high"))
    folded = runs.select(host, "__part", F.size("runs").cast("long").alias("n"), F.aggregate("runs", whole, step).alias("f"))
    parts = folded.groupBy(host).agg(F.sum("n").alias("n_attempts"), F.array_sort(F.collect_list(F.struct("__part", "f"))).alias("parts"))
    return parts.select(host, "n_attempts", F.aggregate("parts", number(1.0), lambda b, x: F.least(F.greatest(b * x.f.factor, x.f.low), x.f.high)).alias("backoff"))


Fetcher = Callable[[str], tuple[str | None, str | None]]


def fetch(pages: DataFrame, fetcher: Fetcher, column: str = "page") -> DataFrame:
    """pages with html and fetch_error from fetcher(url) -> (html, error), a batch at a time; a raised error becomes fetch_error."""
    columns = pages.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = []
            for url in batch[column]:
                try:
                    got.append(fetcher(url) if url and url.strip() else (None, None))
                except Exception as e:  # noqa: BLE001  whatever a fetcher raises is the row's error
                    got.append((None, str(e)))
            yield batch.assign(html=[x[0] for x in got], fetch_error=[x[1] for x in got])[[*columns, "html", "fetch_error"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    return pages.mapInPandas(run, f"{schema}, html string, fetch_error string")
