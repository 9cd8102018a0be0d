"""Links: parts by regular expression, as strict parsers refuse real links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import strip

SOCIAL_HOSTS = ("instagram.com", "www.instagram.com", "m.instagram.com")
VIDEO_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "youtu.be")
RESULT = "struct<platform:string,platform_item_id:string,canonical_url:string,original_url:string,error_code:string>"


FIELDS = [f"__url_{k}" for k in ("raw", "full", "place", "scheme", "path", "query", "user", "host", "parts")]


def with_parts(df: DataFrame, url: str) -> DataFrame:
    """df with the parts of a shared link in columns of their own (FIELDS), which the forms below
    read many times; a link without a scheme is taken as https."""
    raw, full, place = F.col("__url_raw"), F.col("__url_full"), F.col("__url_place")
    return (
        df.withColumn("__url_raw", strip(F.coalesce(F.col(url), F.lit(""))))
        .withColumn("__url_full", F.when(F.contains(raw, F.lit("://")), raw).otherwise(F.concat(F.lit("https://"), raw)))
        .withColumns({"__url_place": F.regexp_extract(full, r"^[^:/?#]+://([^/?#]*)", 1), "__url_scheme": F.lower(F.regexp_extract(full, r"^([^:/?#]+)://", 1)), "__url_path": F.regexp_extract(full, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), "__url_query": F.regexp_extract(full, r"^[^:/?#]+://[^/?#]*[^?#]*\?([^#]*)", 1)})
        .withColumns({"__url_user": F.regexp_extract(place, "^(.*)@", 1), "__url_host": F.lower(F.regexp_extract(F.regexp_extract(place, "([^@]*)$", 1), "^([^:]*)", 1)), "__url_parts": F.filter(F.split("__url_path", "/"), lambda x: x != "")})
    )


class Url:
    """Those columns."""

    def __init__(self):
        self.raw, _, _, self.scheme, self.path, self.query, self.user, self.host, self.parts = map(F.col, FIELDS)


def _result(u: Url, platform: str, item: Column, canonical: Column, error: Column) -> Column:
    ok = error.isNull()
    values = (F.when(ok, F.lit(platform)), F.when(ok, item), F.when(ok, canonical), u.raw, error)
    return F.struct(*[v.alias(n) for v, n in zip(values, ("platform", "platform_item_id", "canonical_url", "original_url", "error_code"), strict=True)])


def social() -> Column:
    """A post's canonical form, or the code of what is wrong with it."""
    u = Url()
    kind, code = F.lower(F.get(u.parts, 0)), F.get(u.parts, 1)
    error = (
        F.when(u.raw == "", "INVALID_URL")
        .when(~u.scheme.isin("http", "https"), "INVALID_URL")
        .when(~u.host.rlike("^[a-z0-9.-]+$"), "INVALID_URL")
        .when(~u.host.isin(*SOCIAL_HOSTS), "UNSUPPORTED_SOURCE")
        .when((F.size(u.parts) != 2) | ~kind.isin("reel", "reels", "p"), "INVALID_URL")
        .when(~code.rlike("^[A-Za-z0-9_-]{2,128}$"), "INVALID_URL")
    )
    return _result(u, "instagram", code, F.concat(F.lit("https://instagram.com/"), F.when(kind == "p", "p").otherwise("reel"), F.lit("/"), code), error)


def video() -> Column:
    """A video's watch link, or the code of what is wrong with it."""
    u = Url()
    short = F.when((u.host == "youtu.be") & (F.size(u.parts) == 1), F.get(u.parts, 0))
    watch = F.when((u.host != "youtu.be") & (F.regexp_replace(u.path, "/+$", "") == "/watch"), F.nullif(F.regexp_extract(u.query, "(?:^|&)v=([^&]*)", 1), F.lit("")))
    other = F.when((u.host != "youtu.be") & (F.size(u.parts) == 2) & F.lower(F.get(u.parts, 0)).isin("shorts", "live", "embed"), F.get(u.parts, 1))
    item = F.coalesce(short, watch, other)
    error = (
        F.when(u.raw == "", "INVALID_URL")
        .when(~u.scheme.isin("http", "https"), "INVALID_URL")
        .when(~u.host.isin(*VIDEO_HOSTS), "UNSUPPORTED_SOURCE")
        .when(item.isNull() | ~item.rlike("^[A-Za-z0-9_-]{6,32}$"), "INVALID_URL")
    )
    return _result(u, "youtube", item, F.concat(F.lit("https://www.youtube.com/watch?v="), item), error)


def web() -> Column:
    """U4: a page's canonical link and its hash, or the code of what is wrong with it."""
    u = Url()
    canonical = F.concat(F.lit("https://"), u.host, F.when(u.path == "", "/").otherwise(u.path), F.when(u.query != "", F.concat(F.lit("?"), u.query)).otherwise(F.lit("")))
    bad_host = ~u.host.rlike("^[a-z0-9.-]{1,253}$") | u.host.startswith("-") | u.host.endswith("-") | F.contains(u.host, F.lit(".."))
    error = F.when(u.raw == "", "INVALID_URL").when(u.scheme != "https", "INVALID_URL").when(~u.user.isin("", ":"), "INVALID_URL").when(bad_host, "INVALID_URL")
    return _result(u, "web", F.sha2(canonical.cast("binary"), 256), canonical, error)


def route() -> Column:
    """By host: posts, videos, else pages."""
    host = Url().host
    return F.when(host.isin(*SOCIAL_HOSTS), social()).when(host.isin(*VIDEO_HOSTS), video()).otherwise(web())
