"""Links, hosts, uploads and queries as they come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import urls
from larder.functions.text import collapse, strip
from larder.session import shared_folder

#: IPv4 networks that are not public.
PRIVATE_NETWORKS = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4")
EXTENSIONS = {"video/mp4": "mp4", "video/quicktime": "mov", "video/webm": "webm", "image/jpeg": "jpg", "image/png": "png", "image/webp": "webp"}
VIDEO_EXTENSIONS, IMAGE_EXTENSIONS = ("mp4", "mov", "webm", "m4v"), ("jpg", "jpeg", "png", "webp")


def extract_urls(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, pos, url) of the distinct links of a text, in order."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"https?://[^\s<>\"']+"), 0)
    links = F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;!?)\]]+$", "")))
    return df.select(key, F.posexplode(links).alias("pos", "url"))


def canonicalize(df: DataFrame, url: str, how=urls.route) -> DataFrame:
    """All columns, and those of the canonical form (`how`: urls.social, video, web, route)."""
    return urls.with_parts(df, url).withColumn("__url", how()).select("*", "__url.*").drop("__url", *urls.FIELDS)


def rejection_report(df: DataFrame, url: str) -> DataFrame:
    """Rejected links by code and host."""
    # counted per code and unpivoted: a filter on the code would be pushed below the aggregate
    # and repeat the whole parser there
    codes = urls.with_parts(df, url).select(F.col("__url_host").alias("host"), urls.route()["error_code"].alias("error_code"))
    counts = codes.groupBy("host").agg(*[F.count_if(F.col("error_code") == c).alias(c) for c in ("INVALID_URL", "UNSUPPORTED_SOURCE")])
    return counts.unpivot("host", ["INVALID_URL", "UNSUPPORTED_SOURCE"], "error_code", "n").where("n > 0")


def allowed_asset(df: DataFrame, url: str, suffixes: list[str]) -> DataFrame:
    """`allowed`: https, and the host is one of suffixes or below one."""
    u, within = urls.Url(), F.lit(False)
    for s in suffixes:
        within = within | (u.host == s) | u.host.endswith("." + s)
    return urls.with_parts(df, url).withColumn("allowed", (u.scheme == "https") & within).drop(*urls.FIELDS)


def ipv4_number(c: Column) -> Column:
    """A dotted address as a number, null where it is none."""
    parts = F.transform(F.split(c, r"\."), lambda p: F.when(p.rlike("^[0-9]{1,3}$"), p.cast("long")))
    good = (F.size(parts) == 4) & F.forall(parts, lambda p: p.isNotNull() & (p <= 255))
    return F.when(good, F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p))


def private_ranges(spark: SparkSession) -> DataFrame:
    """(first, last) of each network that is not public: a table of fixed size."""
    rows = []
    for net in PRIVATE_NETWORKS:
        base, bits = net.split("/")
        first = sum(int(p) << s for p, s in zip(base.split("."), (24, 16, 8, 0), strict=True))
        rows.append((first, first + (1 << (32 - int(bits))) - 1))
    return spark.createDataFrame(rows, "first long, last long")


def public_hosts(ips: DataFrame, host: str = "host", ip: str = "ip") -> DataFrame:
    """U8: (host, public): a host is public if all of its addresses are. What is not an IPv4
    address is public only as an IPv6 address of 2000::/3."""
    n = ips.select(F.col(host).alias("host"), ipv4_number(F.col(ip)).alias("n"), F.lower(ip).alias("ip"))
    ranges = F.broadcast(private_ranges(ips.sparkSession))
    met = n.join(ranges, (F.col("n") >= F.col("first")) & (F.col("n") <= F.col("last")), "left")
    bad = F.when(F.col("n").isNotNull(), F.col("first").isNotNull()).otherwise(~F.coalesce(F.col("ip").rlike("^[23][0-9a-f]{3}:[0-9a-f:]+$"), F.lit(False)))
    return met.groupBy("host").agg((~F.bool_or(bad)).alias("public"))


def classify_fetch(df: DataFrame, max_bytes: int = 2 * 1024 * 1024) -> DataFrame:
    """`outcome` of a fetch by status (null: network failure), content_type and body_bytes."""
    s = F.col("status")
    html = F.coalesce(F.lower("content_type").rlike("^(text/html|application/xhtml)"), F.lit(False))
    outcome = (
        F.when(s.isNull() | (s == 429) | (s >= 500), "retryable")
        .when(s.isin(401, 403), "auth")
        .when(s.isin(404, 410), "gone")
        .when((s == 200) & html & (F.col("body_bytes") <= max_bytes), "ok")
        .otherwise("unsupported")
    )
    return df.withColumn("outcome", outcome)


def resolve_redirects(starts: DataFrame, log: DataFrame, max_hops: int = 5) -> DataFrame:
    """(url, final_url, hops, outcome) of each start: log has (url, target), target null
    where a page answered. Every hop is canonicalized again. Ends: ok, unsupported (a loop, too
    many hops, or a target that is no page), unknown (not in the log).

    The log has one row per url; finished chains leave the join at each hop.
    """
    shared_folder(starts.sparkSession)
    one = log.groupBy("url").agg(F.min("target").alias("target"))
    canon = canonicalize(one, "target", urls.web).select(F.col("url").alias("at"), F.col("target").isNotNull().alias("moved"), F.col("canonical_url").alias("to"))
    known = canon.checkpoint()
    open_ = starts.select("url", F.col("url").alias("at"), F.array("url").alias("path")).distinct()
    done = None
    for hop in range(max_hops + 1):
        outcome = (
            F.when(F.col("moved").isNull(), "unknown")
            .when(~F.col("moved"), "ok")
            .when(F.col("to").isNull() | F.array_contains("path", F.col("to")) | F.lit(hop == max_hops), "unsupported")
        )
        step = open_.join(known, "at", "left").withColumn("outcome", outcome).checkpoint()
        ended = step.where("outcome is not null").select("url", F.col("at").alias("final_url"), F.lit(hop).alias("hops"), "outcome")
        done = ended if done is None else done.unionByName(ended)
        open_ = step.where("outcome is null").select("url", F.col("to").alias("at"), F.array_append("path", F.col("to")).alias("path"))
    return done


def clean_uploads(df: DataFrame, name: str = "filename", kind: str = "content_type") -> DataFrame:
    """clean_name (no folders, only letters, digits, dot, dash and underscore, 120 characters),
    clean_type (lower case, without parameters) and extension (null for other types)."""
    base = F.element_at(F.split(F.col(name), r"[/\\]"), -1)
    clean = F.substring(F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", ""), 1, 120)
    plain = F.trim(F.lower(F.element_at(F.split(F.col(kind), ";"), 1)))
    ext = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return df.withColumns({"clean_name": F.coalesce(F.nullif(clean, F.lit("")), F.lit("upload")), "clean_type": plain, "extension": F.try_element_at(ext, plain)})


def media_kind(df: DataFrame, name: str) -> DataFrame:
    """`kind` by extension: video, image, else unknown."""
    ext = F.lower(F.regexp_extract(F.col(name), r"\.([A-Za-z0-9]+)$", 1))
    return df.withColumn("kind", F.when(ext.isin(*VIDEO_EXTENSIONS), "video").when(ext.isin(*IMAGE_EXTENSIONS), "image").otherwise("unknown"))


def normalize_query(c: Column) -> Column:
    """Collapsed and in lower case."""
    return F.lower(collapse(c))


def normalize_email(c: Column) -> Column:
    """In lower case without outer blanks; null where it is no address of up to 320 characters."""
    e = F.lower(strip(c))
    return F.when((F.length(e) <= 320) & e.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), e)
