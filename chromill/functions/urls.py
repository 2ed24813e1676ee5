"""URL resolution as columns (RFC 3986, section 5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def join_url(base: Column, url: Column) -> Column:
    """url resolved against base; an empty or null url passes through.

    Absolute URLs stay, '//host' takes the scheme, '/path' the host, '?q' and '#f' the page, and anything else the
    page's folder; './' and 'x/../' segments of a resolved path are taken out.
    """
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(F.length(page) > F.length(host), F.regexp_extract(page, r"^(.*/)", 1)).otherwise(F.concat(host, F.lit("/")))
    joined = (
        F.when(url.isNull() | (url == ""), url)
        .when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), url)
        .when(url.startswith("//"), F.concat(scheme, F.lit(":"), url))
        .when(url.startswith("/"), _clean(F.concat(host, url)))
        .when(url.startswith("?"), F.concat(page, url))
        .when(url.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), url))
        .otherwise(_clean(F.concat(folder, url)))
    )
    return joined


def _clean(url: Column) -> Column:
    """A resolved URL whose path has no dot segments; a fold over the segments, so any depth is taken back."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    head = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    tail = F.regexp_extract(url, r"^[^?#]*([?#].*)$", 1)
    parts = F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/")))
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda out, p: F.when(p == ".", out).when(p == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p))))
    ends_in_folder = F.element_at(parts, -1).isin(".", "..")
    clean = F.concat(head, F.lit("/"), F.array_join(kept, "/"), F.when(ends_in_folder & (F.size(kept) > 0), "/").otherwise(""), tail)
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), clean).otherwise(url)
