"""Catalogue of the scraping and incremental operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.html import detail_map
from ..functions.urls import join_url
from ..operators import scrape as s
from . import derived as d


def q_scrape_clean(spark, sf_dir):
    """C6, C7, C8, I18"""
    raw = d.table(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), F.when(F.col("page_id") % 5 == 0, "none").otherwise(F.concat(F.lit('url("'), "url", F.lit('")'))).alias("image"))
    return s.clean_crawl(raw).select("index", "image", "filename")


def q_scrape_cascade(spark, sf_dir):
    """I23, I24, I25, I26, I27, I28"""
    return s.extract_images(d.html(spark, sf_dir), exact_json=False).select("page_id", "image_url", "source")


def r_scrape_cascade_parsed(spark, sf_dir):
    """I25, I28 with JSON-LD in document order"""
    return s.extract_images(d.html(spark, sf_dir)).select("page_id", "image_url", "source")


def q_scrape_cascade_markup(spark, sf_dir):
    """References, comments, scripts and images without a source"""
    return s.extract_images(d.markup(spark, sf_dir), exact_json=False).select("page_id", "image_url", "source")


def _status_rows(spark, sf_dir):
    p = d.html(spark, sf_dir)
    i = F.col("page_id")
    return p.select(
        F.concat(i.cast("string"), F.lit(".jpg")).alias("filename"), F.when(i % 11 == 0, F.lit("  ")).otherwise(F.col("page")).alias("page"),
        F.when(i % 13 == 0, F.lit("HTTP 500")).alias("fetch_error"), F.when(i % 6 == 4, F.lit(None).cast("string")).otherwise(F.concat(F.lit("https://x.org/"), i.cast("string"))).alias("image_url"),
        F.when(i % 6 == 4, "none_found").otherwise("og:image").alias("source"), F.element_at(F.array(*[F.lit(x) for x in (200, 403, 405, 429, 404)]), (i % 5 + 1).cast("int")).alias("head"),
        F.when(i % 2 == 0, 200).otherwise(410).alias("get"), F.when(i % 17 == 0, "timeout").alias("verify_error"),
    )


def q_scrape_status(spark, sf_dir):
    """C10, I29, I30"""
    return s.row_status(_status_rows(spark, sf_dir), robust=True)


def q_scrape_largest_img(spark, sf_dir):
    """I22, I27"""
    return s.largest_image(s.image_tags(d.html(spark, sf_dir)))


def q_url_join(spark, sf_dir):
    """I21"""
    i = F.col("page_id")
    forms = ("img/a.jpg", "/img/b.jpg", "//cdn.example.org/c.jpg", "https://other.example.org/d.jpg", "", "?q=1", "../e.jpg", "./f/../g.jpg", "#top")
    rel = F.element_at(F.array(*[F.lit(x) for x in forms]), (i % len(forms) + 1).cast("int"))
    return d.table(spark, sf_dir, "pages").select("page_id", join_url(F.col("url"), rel).alias("joined"))


def q_resume_anti_join(spark, sf_dir):
    """A5, C12, D3"""
    return s.remaining(d.table(spark, sf_dir, "pages").select("page_id", "url"), d.done(spark, sf_dir), "page_id")


def q_start_from_suffix(spark, sf_dir):
    """C13"""
    rows = d.table(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), F.concat(F.col("page_id").cast("string"), F.lit(".jpg")).alias("filename"))
    return s.from_key(rows, "filename", "20.jpg")


def q_take_until_prefix(spark, sf_dir):
    """C14"""
    rows = d.table(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), F.concat(F.col("page_id").cast("string"), F.lit(".jpg")).alias("filename"))
    return s.until_key(rows, "filename", "20.jpg")


def q_batch_numbers(spark, sf_dir):
    """F9, I31"""
    docs = d.table(spark, sf_dir, "documents").select("doc_id")
    return s.batch_numbers(docs, [F.col("doc_id")], 13, existing=2).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("batch").cast("long").alias("batch"))


def q_first_wins_dedup(spark, sf_dir):
    """F8"""
    docs = d.table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return s.first_wins(docs, ["n_chars", "lang"], [F.col("doc_id")])


def q_source_union(spark, sf_dir):
    """H1, H3, C5"""
    pages = d.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind"))
    docs = d.table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"))
    return pages.unionByName(docs)


def q_detail_map(spark, sf_dir):
    """A13"""
    i = F.col("page_id").cast("string")
    items = F.array(F.concat(F.lit("Title: work "), i), F.concat(F.lit("Date: 19"), i, F.lit(": circa")), F.concat(F.lit("Title: again "), i), F.lit("museum:x"), F.concat(F.lit("location:"), "url"))
    return d.table(spark, sf_dir, "pages").select("page_id", F.explode(detail_map(items)).alias("key", "value"))


def q_success_rate(spark, sf_dir):
    """E19, E20"""
    rows = d.attempts(spark, sf_dir).select("host", F.when(F.col("status") == 200, "ok").otherwise("error").alias("status"))
    return s.success_rate(rows, "host").select("host", "n", "n_ok", F.round("rate", 6).alias("rate"))


def q_backoff_state(spark, sf_dir):
    """J3"""
    return s.backoff(d.attempts(spark, sf_dir)).select("host", "n_attempts", F.round("backoff", 6).alias("backoff"))


QUERIES = [
    q_scrape_clean, q_scrape_cascade, r_scrape_cascade_parsed, q_scrape_cascade_markup, q_scrape_status, q_scrape_largest_img, q_url_join, q_resume_anti_join, q_start_from_suffix, q_take_until_prefix,
    q_batch_numbers, q_first_wins_dedup, q_source_union, q_detail_map, q_success_rate, q_backoff_state,
]

_JOIN = """case when {u} is null or {u} = '' then {u} when regexp_matches({u}, '^[A-Za-z][A-Za-z0-9+.-]*:') then {u}
 when starts_with({u}, '//') then regexp_extract({b}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) || ':' || {u}
 when starts_with({u}, '/') then regexp_extract({b}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || {u}
 when starts_with({u}, '?') then regexp_extract({b}, '^([^?#]*)', 1) || {u}
 when starts_with({u}, '#') then regexp_extract({b}, '^([^#]*)', 1) || {u}
 else (case when length(regexp_extract({b}, '^([^?#]*)', 1)) > length(regexp_extract({b}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) then regexp_extract(regexp_extract({b}, '^([^?#]*)', 1), '^(.*/)', 1) else regexp_extract({b}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/' end) || {u} end"""
_UP = r"regexp_replace(regexp_replace({x}, '^([a-z]+://[^/]+)((?:/[^/]+)*?)/[^/]+/\.\./', '\1\2/'), '^([a-z]+://[^/]+)/\.\./', '\1/')"

SQL = {
    "q_scrape_cascade_markup": """select page_id, ['og:image', 'fallback:img', 'fallback:img', 'none_found', 'twitter:image', 'fallback:img'][page_id % 6 + 1] as source,
      ['https://x.org/i?a=1&b=' || page_id, 'https://x.org/a' || page_id || '.jpg', 'https://x.org/d' || page_id || '.jpg', null, 'https://x.org/<t' || page_id || '>?x=1&copy=2', 'https://x.org/s' || page_id || '.jpg'][page_id % 6 + 1] as image_url from pages""",
    "q_scrape_clean": "select page_id as \"index\", url as image, page_id || '.jpg' as filename from pages where page_id % 5 <> 0",
    "q_scrape_cascade": f"""with {d.HTML}, m as (select page_id, page, html, regexp_extract(html, '<meta property="og:image" content="([^"]*)"', 1) as og, regexp_extract(html, '<meta name="twitter:image" content="([^"]*)"', 1) as tw,
      regexp_extract(html, 'ld\\+json">(.*?)</script>', 1) as ld from html),
      j as (select *, case when ld = '' then '' when json_type(ld, '$.image') = 'VARCHAR' then ld ->> '$.image' when json_type(ld, '$.image') = 'OBJECT' then ld ->> '$.image.url' else ld ->> '$.image[0]' end as ldimg, regexp_extract(html, 'data-src="([^"]*)"', 1) as img from m),
      p as (select page_id, page, case when og <> '' then og when tw <> '' then tw when ldimg <> '' then ldimg when page_id % 6 = 3 then img end as url, case when og <> '' then 'og:image' when tw <> '' then 'twitter:image' when ldimg <> '' then 'jsonld' when page_id % 6 = 3 then 'fallback:img' else 'none_found' end as source from j),
      r as (select page_id, source, {_JOIN.format(u='url', b='page')} as image_url from p)
      select page_id, source, case when source = 'fallback:img' then {_UP.format(x='image_url')} else image_url end as image_url from r""",
    "q_scrape_status": """with x as (select page_id as i, page_id || '.jpg' as filename, case when page_id % 11 = 0 then '  ' else url end as page, case when page_id % 13 = 0 then 'HTTP 500' end as fe, case when page_id % 6 <> 4 then 'https://x.org/' || page_id end as u,
      case when page_id % 6 = 4 then 'none_found' else 'og:image' end as s, [200, 403, 405, 429, 404][page_id % 5 + 1] as head, case when page_id % 2 = 0 then 200 else 410 end as get, case when page_id % 17 = 0 then 'timeout' end as ve from pages),
      y as (select *, case when trim(page) = '' then 'empty_page_url' when fe is not null then 'page_fetch_failed: ' || fe when u is null then 'no_image_found' when ve is not null then 'verify_failed: ' || ve when head = 200 then '' when head = 403 then 'HEAD returned 403 but image likely valid'
        when head = 429 then 'rate limited (429) but likely valid' when head = 405 and get = 200 then '' when head = 405 then 'HTTP ' || get else 'HTTP ' || head end as notes from x)
      select filename, page, case when trim(page) = '' or fe is not null then '' else coalesce(u, '') end as image_url, case when trim(page) = '' or fe is not null then '' else s end as source,
        case when trim(page) <> '' and fe is null and u is not null and ve is null and (head in (200, 403, 429) or head = 405 and get = 200) then 'ok' else 'error' end as status, notes from y""",
    "q_scrape_largest_img": f"""with {d.HTML}, t as (select page_id, unnest(regexp_extract_all(html, '<img\\b[^>]*>')) as tag, generate_subscripts(regexp_extract_all(html, '<img\\b[^>]*>'), 1) as pos from html),
      a as (select page_id, pos, coalesce(nullif(regexp_extract(tag, ' src="([^"]*)"', 1), ''), nullif(regexp_extract(tag, 'data-src="([^"]*)"', 1), '')) as src, coalesce(try_cast(regexp_replace(regexp_extract(tag, 'width="([^"]*)"', 1), '[^0-9]', '', 'g') as bigint) * try_cast(regexp_replace(regexp_extract(tag, 'height="([^"]*)"', 1), '[^0-9]', '', 'g') as bigint), 0) as area from t)
      select page_id, src, area from a where area > 10000 or area = 0 qualify row_number() over (partition by page_id order by area > 10000 desc, area desc, pos) = 1""",
    "q_url_join": f"""with x as (select page_id, url, ['img/a.jpg', '/img/b.jpg', '//cdn.example.org/c.jpg', 'https://other.example.org/d.jpg', '', '?q=1', '../e.jpg', './f/../g.jpg', '#top'][page_id % 9 + 1] as rel from pages),
      y as (select page_id, rel, {_JOIN.format(u='rel', b='url')} as j from x) select page_id, case when rel = '../e.jpg' then {_UP.format(x='j')} when rel = './f/../g.jpg' then replace(j, './f/../', '') else j end as joined from y""",
    "q_resume_anti_join": "select page_id, url from pages where page_id not in (select page_id from pages where page_id % 3 = 0)",
    "q_start_from_suffix": "with r as (select page_id as pos, page_id || '.jpg' as filename from pages) select * from r where pos >= coalesce((select min(pos) from r where filename = '20.jpg'), 0)",
    "q_take_until_prefix": "with r as (select page_id as pos, page_id || '.jpg' as filename from pages) select * from r where pos < coalesce((select min(pos) from r where filename = '20.jpg'), 9223372036854775807)",
    "q_batch_numbers": "select doc_id, row_number() over (order by doc_id) as pos, cast((row_number() over (order by doc_id) - 1) // 13 + 3 as bigint) as batch from documents",
    "q_first_wins_dedup": "select doc_id, n_chars, lang from documents qualify row_number() over (partition by n_chars, lang order by doc_id) = 1",
    "q_source_union": "select page_id as id, 'page' as kind from pages union all select doc_id, 'document' from documents",
    "q_detail_map": "select page_id, 'Date' as key, ' 19' || page_id || ' circa' as value from pages union all select page_id, 'Title', ' again ' || page_id from pages union all select page_id, 'museum', 'x' from pages union all select page_id, 'location', replace(url, ':', '') from pages",
    "q_success_rate": f"with {d.ATTEMPTS} select host, count(*) as n, count(*) filter (where status = 200) as n_ok, round(100.0::double * count(*) filter (where status = 200) / count(*), 6) as rate from attempts group by host",
    "q_backoff_state": f"""with recursive {d.ATTEMPTS}, o as (select host, status, row_number() over (partition by host order by ts, event_id) as i, count(*) over (partition by host) as n from attempts),
      f as (select host, n, 0::bigint as i, 1.0::double as b from o where i = 1 union all select f.host, f.n, o.i, case when o.status = 200 then greatest(f.b * 0.9::double, 0.5::double) when o.status = 429 then least(f.b * 1.5::double, 5.0::double) else f.b end from f join o on o.host = f.host and o.i = f.i + 1)
      select host, n as n_attempts, round(b, 6) as backoff from f where i = n""",
}
