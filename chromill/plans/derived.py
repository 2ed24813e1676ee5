"""Relations derived from the tables, which stand for images, pages and crawls; each in Spark and as a WITH clause."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import COLOUR_NAMES, FEATURES_18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pal12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, label and 12 shares from an embedding's first components."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.abs(F.col("embedding")[i].cast("double")).alias(f"raw_{c}") for i, c in enumerate(COLOUR_NAMES)])
    total = F.col(f"raw_{COLOUR_NAMES[0]}")
    for c in COLOUR_NAMES[1:]:
        total = total + F.col(f"raw_{c}")
    return e.withColumn("total", total).select(F.concat(F.lit("img_"), F.col("vec_id").cast("string")).alias("url"), "label", *[(F.col(f"raw_{c}") / F.col("total")).alias(c) for c in COLOUR_NAMES])


_RAW = ", ".join(f"abs(cast(embedding[{i + 1}] as double)) as raw_{c}" for i, c in enumerate(COLOUR_NAMES))
_TOTAL = " + ".join(f"raw_{c}" for c in COLOUR_NAMES)
PAL12 = f"raw12 as (select vec_id, label, {_RAW} from embeddings), pal12 as (select 'img_' || vec_id as url, label, {', '.join(f'raw_{c} / ({_TOTAL}) as {c}' for c in COLOUR_NAMES)} from raw12)"


def feat18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filename, color, cluster_id and the 18 features, from an embedding's first components."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.col("vec_id").cast("string"), F.lit(".jpg")).alias("filename"), "vec_id", F.col("label").alias("color"), F.col("label").alias("cluster_id"), *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(FEATURES_18)])


FEAT18 = f"feat18 as (select vec_id || '.jpg' as filename, vec_id, label as color, label as cluster_id, {', '.join(f'cast(embedding[{i + 1}] as double) as {f}' for i, f in enumerate(FEATURES_18))} from embeddings)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("image_id"), (F.col("l_orderkey") % 256).cast("int").alias("r"), (F.col("l_partkey") % 256).cast("int").alias("g"),
        ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 31) % 256).cast("int").alias("b"),
    )


PIXELS = "pixels as (select l_suppkey as image_id, cast(l_orderkey % 256 as integer) as r, cast(l_partkey % 256 as integer) as g, cast((l_orderkey * 7 + l_linenumber * 31) % 256 as integer) as b from lineitem)"


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    return p.select(*[(F.col(c) - F.col(c) % 32).alias(c) for c in "rgb"]).distinct()


COLOURS_SQL = PIXELS + ", colours as (select distinct r - r % 32 as r, g - g % 32 as g, b - b % 32 as b from pixels)"


def csize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 21).cast("int").alias("cluster_id")).agg(F.count("*").alias("size"))


CSIZE = "csize as (select cast(o_custkey % 21 as integer) as cluster_id, count(*) as size from orders group by 1)"

# tags put into each page by page_id % 6: og, twitter, JSON-LD, two images, nothing, an empty og with twitter
_TAGS = (
    "'<meta property=\"og:image\" content=\"/img/og' || {p} || '.jpg\">'",
    "'<meta name=\"twitter:image\" content=\"//cdn.example.org/t' || {p} || '.jpg\">'",
    "'<script type=\"application/ld+json\">' || case when {p} % 4 = 0 then '{{\"image\":\"ld' || {p} || '.jpg\"}}' when {p} % 4 = 2 then '{{\"image\":{{\"url\":\"https://img.example.org/ld' || {p} || '.jpg\"}}}}' else '{{\"image\":[\"first' || {p} || '.jpg\",\"second.jpg\"]}}' end || '</script>'",
    "'<img src=\"small.jpg\" width=\"50\" height=\"40\"><img data-src=\"../big' || {p} || '.jpg\" width=\"' || (200 + {p} % 7) || 'px\" height=\"300\"><img src=\"nodims.jpg\">'",
    "''",
    "'<meta property=\"og:image\" content=\"\"><meta name=\"twitter:image\" content=\"tw' || {p} || '.jpg\">'",
)
_INJECT = "case {p} % 6 " + " ".join(f"when {i} then {t}" for i, t in enumerate(_TAGS)) + " end"
HTML = f"html as (select page_id, url as page, {_INJECT.format(p='cast(page_id as varchar)').replace('cast(page_id as varchar) %', 'page_id %').replace('200 + page_id', '200 + page_id')} || html as html from pages)"


def html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with image tags put in front, as raw pages have none."""
    inject = _INJECT.format(p="cast(page_id as string)").replace("cast(page_id as string) %", "page_id %")
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page"), F.concat(F.expr(inject), "html").alias("html"))


# pages whose markup hides or disguises the image, by page_id % 6: references in a URL, an image without a source, one in a
# comment, one in a script, references with and without an end, a larger image that has no source
_MARKUP = (
    """'<meta property="og:image" content="https://x.org/i?a=1&amp;b=' || {p} || '">'""",
    """'<img alt="x"><img src="https://x.org/a' || {p} || '.jpg">'""",
    """'<!-- <img src="c.jpg" width="900" height="900"> --><img src="https://x.org/d' || {p} || '.jpg">'""",
    """'<script>var a = "<img src=e.jpg>";</script><style>/* <meta property="og:image" content="f.jpg"> */</style>' || ''""",
    """'<meta name="twitter:image" content="https://x.org/&lt;t' || {p} || '&#62;?x=1&copy=2">'""",
    """'<img width="900" height="900"><img src="https://x.org/s' || {p} || '.jpg" width="200" height="100">'""",
)


def markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = "case page_id % 6 " + " ".join(f"when {i} then {t.format(p='cast(page_id as string)')}" for i, t in enumerate(_MARKUP)) + " end"
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page"), F.concat(F.expr(forms), "html").alias("html"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch attempts: host, order and HTTP status, from events."""
    status = F.when(F.col("event_type") == "error", 429).when(F.col("event_type") == "signup", 403).when(F.col("event_type") == "purchase", 405).otherwise(200)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("host"), "ts", "event_id", "event_type", "value", status.alias("status"))


ATTEMPTS = "attempts as (select user_id as host, ts, event_id, event_type, value, case event_type when 'error' then 429 when 'signup' then 403 when 'purchase' then 405 else 200 end as status from events)"


def done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where("page_id % 3 = 0").select("page_id", "url")
