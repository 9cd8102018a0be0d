"""U1-U13 over pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import urls
from larder.operators import intake
from larder.plans.base import Plans, view

plan = Plans()

# the parts of shared_v.url, as functions.urls takes them
_PARTS = r"""
parts AS (
    SELECT page_id, raw, lower(regexp_extract(f, '^([^:/?#]+)://', 1)) AS scheme,
        regexp_extract(regexp_extract(f, '^[^:/?#]+://([^/?#]*)', 1), '^(.*)@', 1) AS usr,
        lower(regexp_extract(regexp_extract(regexp_extract(f, '^[^:/?#]+://([^/?#]*)', 1), '([^@]*)$', 1), '^([^:]*)', 1)) AS host,
        regexp_extract(f, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path,
        regexp_extract(f, '^[^:/?#]+://[^/?#]*[^?#]*\?([^#]*)', 1) AS query
    FROM (SELECT page_id, raw, CASE WHEN contains(raw, '://') THEN raw ELSE 'https://' || raw END AS f
          FROM (SELECT page_id, regexp_replace(coalesce(url, ''), '^\s+|\s+$', '', 'g') AS raw FROM shared_v))),
p AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM parts),
social AS (SELECT page_id, lower(parts[1]) AS kind, parts[2] AS code, raw,
    CASE WHEN raw = '' THEN 'INVALID_URL' WHEN scheme NOT IN ('http', 'https') THEN 'INVALID_URL'
         WHEN NOT regexp_matches(host, '^[a-z0-9.-]+$') THEN 'INVALID_URL'
         WHEN host NOT IN ('instagram.com', 'www.instagram.com', 'm.instagram.com') THEN 'UNSUPPORTED_SOURCE'
         WHEN len(parts) <> 2 OR lower(parts[1]) NOT IN ('reel', 'reels', 'p') THEN 'INVALID_URL'
         WHEN NOT regexp_matches(parts[2], '^[A-Za-z0-9_-]{2,128}$') THEN 'INVALID_URL' END AS error FROM p),
vid AS (SELECT *, coalesce(
        CASE WHEN host = 'youtu.be' AND len(parts) = 1 THEN parts[1] END,
        CASE WHEN host <> 'youtu.be' AND regexp_replace(path, '/+$', '') = '/watch' THEN nullif(regexp_extract(query, '(?:^|&)v=([^&]*)', 1), '') END,
        CASE WHEN host <> 'youtu.be' AND len(parts) = 2 AND lower(parts[1]) IN ('shorts', 'live', 'embed') THEN parts[2] END) AS item FROM p),
video AS (SELECT page_id, item, raw,
    CASE WHEN raw = '' THEN 'INVALID_URL' WHEN scheme NOT IN ('http', 'https') THEN 'INVALID_URL'
         WHEN host NOT IN ('youtube.com', 'www.youtube.com', 'm.youtube.com', 'youtu.be') THEN 'UNSUPPORTED_SOURCE'
         WHEN item IS NULL OR NOT regexp_matches(item, '^[A-Za-z0-9_-]{6,32}$') THEN 'INVALID_URL' END AS error FROM vid),
web AS (SELECT page_id, raw, 'https://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canon,
    CASE WHEN raw = '' THEN 'INVALID_URL' WHEN scheme <> 'https' THEN 'INVALID_URL' WHEN usr NOT IN ('', ':') THEN 'INVALID_URL'
         WHEN NOT regexp_matches(host, '^[a-z0-9.-]{1,253}$') OR host LIKE '-%' OR host LIKE '%-' OR contains(host, '..') THEN 'INVALID_URL' END AS error FROM p),
socialr AS (SELECT page_id, CASE WHEN error IS NULL THEN 'instagram' END AS platform, CASE WHEN error IS NULL THEN code END AS platform_item_id,
    CASE WHEN error IS NULL THEN 'https://instagram.com/' || CASE WHEN kind = 'p' THEN 'p' ELSE 'reel' END || '/' || code END AS canonical_url, raw AS original_url, error AS error_code FROM social),
videor AS (SELECT page_id, CASE WHEN error IS NULL THEN 'youtube' END AS platform, CASE WHEN error IS NULL THEN item END AS platform_item_id,
    CASE WHEN error IS NULL THEN 'https://www.youtube.com/watch?v=' || item END AS canonical_url, raw AS original_url, error AS error_code FROM video),
webr AS (SELECT page_id, CASE WHEN error IS NULL THEN 'web' END AS platform, CASE WHEN error IS NULL THEN sha256(canon) END AS platform_item_id,
    CASE WHEN error IS NULL THEN canon END AS canonical_url, raw AS original_url, error AS error_code FROM web),
routed AS (
    SELECT p.host, socialr.* FROM socialr JOIN p USING (page_id) WHERE p.host IN ('instagram.com', 'www.instagram.com', 'm.instagram.com')
    UNION ALL SELECT p.host, videor.* FROM videor JOIN p USING (page_id) WHERE p.host IN ('youtube.com', 'www.youtube.com', 'm.youtube.com', 'youtu.be')
    UNION ALL SELECT p.host, webr.* FROM webr JOIN p USING (page_id) WHERE p.host NOT IN ('instagram.com', 'www.instagram.com', 'm.instagram.com', 'youtube.com', 'www.youtube.com', 'm.youtube.com', 'youtu.be'))
"""
_COLUMNS = "page_id, platform, platform_item_id, canonical_url, original_url, error_code"


@plan(r"""SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, links[pos] AS url FROM (
    SELECT page_id, links, unnest(range(1, len(links) + 1)) AS pos FROM (
        SELECT page_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS links FROM (
            SELECT page_id, list_transform(regexp_extract_all(body, 'https?://[^\s<>"'']+'), lambda u: regexp_replace(u, '[.,;!?)\]]+$', '')) AS l
            FROM (SELECT page_id, 'see ' || url || ' , ' || url || '). then <' || url || '?a=1>!' AS body FROM pages))))""")
def u1_extract_urls(spark, sf_dir):
    pages = view(spark, sf_dir, "pages")
    body = pages.select("page_id", F.expr("'see ' || url || ' , ' || url || '). then <' || url || '?a=1>!'").alias("body"))
    return intake.extract_urls(body, "body", "page_id")


def _canonical(spark, sf_dir, how):
    return intake.canonicalize(view(spark, sf_dir, "shared_v"), "url", how).drop("url")


@plan(f"WITH {_PARTS} SELECT {_COLUMNS} FROM socialr")
def u2_canonicalize_social(spark, sf_dir):
    return _canonical(spark, sf_dir, urls.social)


@plan(f"WITH {_PARTS} SELECT {_COLUMNS} FROM videor")
def u3_canonicalize_video(spark, sf_dir):
    return _canonical(spark, sf_dir, urls.video)


@plan(f"WITH {_PARTS} SELECT {_COLUMNS} FROM webr")
def u4_canonicalize_web(spark, sf_dir):
    return _canonical(spark, sf_dir, urls.web)


@plan(f"WITH {_PARTS} SELECT {_COLUMNS} FROM routed")
def u5_route_urls(spark, sf_dir):
    return _canonical(spark, sf_dir, urls.route)


@plan(f"WITH {_PARTS} SELECT error_code, host, count(*) AS n FROM routed WHERE error_code IS NOT NULL GROUP BY ALL")
def u6_rejection_report(spark, sf_dir):
    return intake.rejection_report(view(spark, sf_dir, "shared_v"), "url")


@plan(f"WITH {_PARTS} SELECT page_id, scheme = 'https' AND (host = 'example.com' OR host LIKE '%.example.com' OR host = 'example.org' OR host LIKE '%.example.org') AS allowed FROM p")
def u7_allowed_asset(spark, sf_dir):
    return intake.allowed_asset(view(spark, sf_dir, "shared_v"), "url", ["example.com", "example.org"]).select("page_id", "allowed")


_IPS = "SELECT cast(floor(event_id / 3) AS bigint) AS host, CASE event_id % 9 WHEN 0 THEN '10.' || cast(event_id % 250 AS string) || '.0.1' WHEN 1 THEN '172.' || cast(event_id % 40 AS string) || '.2.3' WHEN 2 THEN 'none' WHEN 3 THEN '2a00:1450::5' ELSE cast(1 + event_id % 220 AS string) || '.' || cast(event_id % 256 AS string) || '.9.9' END AS ip FROM events"


@plan(f"""WITH ips AS ({_IPS}),
    n AS (SELECT host, ip, CASE WHEN regexp_full_match(ip, '[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}') AND list_max(list_transform(string_split(ip, '.'), lambda x: CAST(x AS BIGINT))) <= 255
        THEN list_reduce(list_transform(string_split(ip, '.'), lambda x: CAST(x AS BIGINT)), lambda a, b: a * 256 + b) END AS n FROM ips),
    nets AS (SELECT CAST(list_reduce(list_transform(string_split(string_split(net, '/')[1], '.'), lambda x: CAST(x AS BIGINT)), lambda a, b: a * 256 + b) AS BIGINT) AS first, CAST(string_split(net, '/')[2] AS INTEGER) AS bits
        FROM (SELECT unnest({list(intake.PRIVATE_NETWORKS)!r}) AS net))
    SELECT host, NOT bool_or(CASE WHEN n IS NOT NULL THEN bad ELSE NOT regexp_matches(lower(ip), '^[23][0-9a-f]{{3}}:[0-9a-f:]+$') END) AS public
    FROM (SELECT *, exists(SELECT 1 FROM nets WHERE n.n >= first AND n.n < first + (CAST(1 AS BIGINT) << (32 - bits))) AS bad FROM n) GROUP BY host""")
def u8_public_hosts(spark, sf_dir):
    view(spark, sf_dir, "captures_v")  # registers events
    return intake.public_hosts(spark.sql(_IPS))


_FETCHES = "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE cast(element_at(array(200, 200, 200, 401, 403, 404, 410, 429, 500, 503, 302), cast(event_id % 11 + 1 AS int)) AS int) END AS status, CASE WHEN event_id % 4 = 0 THEN 'application/pdf' ELSE 'Text/HTML; charset=utf-8' END AS content_type, cast(value * 40000 AS bigint) AS body_bytes FROM events"


@plan("""SELECT event_id, CASE WHEN s IS NULL OR s = 429 OR s >= 500 THEN 'retryable' WHEN s IN (401, 403) THEN 'auth' WHEN s IN (404, 410) THEN 'gone'
    WHEN s = 200 AND event_id % 4 <> 0 AND b <= 2097152 THEN 'ok' ELSE 'unsupported' END AS outcome
    FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ([200, 200, 200, 401, 403, 404, 410, 429, 500, 503, 302])[event_id % 11 + 1] END AS s, CAST(trunc(value * 40000) AS BIGINT) AS b FROM events)""")
def u9_classify_fetch(spark, sf_dir):
    view(spark, sf_dir, "captures_v")
    return intake.classify_fetch(spark.sql(_FETCHES)).select("event_id", "outcome")


# page k answers, or sends on to page k - k % 7: chains of several hops; some pages point at themselves
_HOPS = "SELECT 'https://h.example.com/' || cast(page_id AS string) AS url, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 41 = 1 THEN 'https://h.example.com/' || cast(page_id AS string) || '#x' WHEN page_id % 17 = 1 THEN 'http://h.example.com/0' ELSE 'https://H.example.com:443/' || cast(page_id - 1 - page_id % 2 AS string) || '#f' END AS target FROM pages"


@plan(f"""WITH RECURSIVE log AS ({_HOPS}),
    hop AS (SELECT url, CASE WHEN target LIKE 'https:%' THEN regexp_replace(replace(replace(target, ':443', ''), 'https://H.', 'https://h.'), '#.*$', '') WHEN target IS NOT NULL THEN 'bad' END AS nxt FROM log),
    walk AS (
        SELECT url, url AS cur, 0 AS hops, [url] AS path, CAST(NULL AS VARCHAR) AS outcome FROM hop
        UNION ALL
        SELECT w.url, CASE WHEN o IS NULL THEN nxt ELSE cur END, CASE WHEN o IS NULL THEN hops + 1 ELSE hops END, CASE WHEN o IS NULL THEN list_append(path, nxt) ELSE path END, o FROM (
            SELECT w.*, h.nxt, CASE WHEN h.url IS NULL THEN 'unknown' WHEN h.nxt IS NULL THEN 'ok' WHEN h.nxt = 'bad' OR list_contains(w.path, h.nxt) OR w.hops = 5 THEN 'unsupported' END AS o
            FROM walk w LEFT JOIN hop h ON h.url = w.cur WHERE w.outcome IS NULL) w)
    SELECT url, cur AS final_url, hops, outcome FROM walk WHERE outcome IS NOT NULL""")
def u10_resolve_redirects(spark, sf_dir):
    view(spark, sf_dir, "shared_v")
    log = spark.sql(_HOPS)
    return intake.resolve_redirects(log.select("url"), log)


_UPLOADS = "SELECT page_id, regexp_replace(url, '^[a-z]+:', 'C:') || ' (1)' || CASE page_id % 3 WHEN 0 THEN '.MP4' WHEN 1 THEN '.jpg' ELSE '.' END AS filename, CASE page_id % 3 WHEN 0 THEN 'Video/MP4; codecs=x' WHEN 1 THEN ' image/jpeg ' ELSE 'text/plain' END AS content_type FROM pages"


@plan(rf"""SELECT page_id, coalesce(nullif(substr(regexp_replace(regexp_replace(list_last(string_split_regex(filename, '[/\\]')), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 1, 120), ''), 'upload') AS clean_name,
    trim(lower(string_split(content_type, ';')[1])) AS clean_type,
    CASE trim(lower(string_split(content_type, ';')[1])) WHEN 'video/mp4' THEN 'mp4' WHEN 'image/jpeg' THEN 'jpg' END AS extension FROM ({_UPLOADS})""")
def u11_clean_uploads(spark, sf_dir):
    view(spark, sf_dir, "shared_v")
    return intake.clean_uploads(spark.sql(_UPLOADS)).drop("filename", "content_type")


@plan(rf"""SELECT page_id, CASE WHEN lower(regexp_extract(filename, '\.([A-Za-z0-9]+)$', 1)) IN ('mp4', 'mov', 'webm', 'm4v') THEN 'video' WHEN lower(regexp_extract(filename, '\.([A-Za-z0-9]+)$', 1)) IN ('jpg', 'jpeg', 'png', 'webp') THEN 'image' ELSE 'unknown' END AS kind FROM ({_UPLOADS})""")
def u12_media_kind(spark, sf_dir):
    view(spark, sf_dir, "shared_v")
    return intake.media_kind(spark.sql(_UPLOADS), "filename").select("page_id", "kind")


_EMAILS = "SELECT item_id, '  ' || text || '  X ' AS q, CASE item_id % 3 WHEN 0 THEN ' User' || cast(item_id AS string) || '@Example.COM ' WHEN 1 THEN 'no at sign' ELSE 'a@b' END AS email FROM benchmark"


@plan(rf"""SELECT item_id, lower(trim(regexp_replace(q, '\s+', ' ', 'g'))) AS query, CASE WHEN regexp_matches(lower(trim(email)), '^[^@\s]+@[^@\s]+\.[^@\s]+$') THEN lower(trim(email)) END AS email FROM ({_EMAILS})""")
def u13_normalize(spark, sf_dir):
    view(spark, sf_dir, "benchmark").createOrReplaceTempView("benchmark")
    return spark.sql(_EMAILS).select("item_id", intake.normalize_query(F.col("q")).alias("query"), intake.normalize_email(F.col("email")).alias("email"))
