"""Search branches, fusion, evidence and evaluation.

queries: query_id, user_id, q (text) and, for the vector branches, embedding. Branch rows carry query_id, memory_id
and place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.text import collapse, snippet, visual_snippet
from larder.operators import embed, substrings, textindex
from larder.operators.orderstats import low_place, median, order_statistics
from larder.session import staged

RRF_K = 60
# The evidence type of a segment's modality; others show as TAG.
EVIDENCE = {"speech": "SPEECH", "ocr": "OCR", "visual": "VISUAL", "caption": "CAPTION", "summary": "TAG"}


def visible(memories: DataFrame) -> DataFrame:
    """The memories that search may return."""
    return memories.where(F.col("status").isin("READY", "METADATA_ONLY"))


def _top(rows: DataFrame, order: list, n: int, by: str = "query_id") -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= n)


def vector_branch(queries: DataFrame, segments: DataFrame, n: int = 50) -> DataFrame:
    """K1 as a branch: (query_id, memory_id, segment_id, distance, place) among the user's segments with vectors."""
    near = embed.knn(queries, segments, n, key="segment_id", scope="user_id")
    return near.join(segments.select("segment_id", "memory_id"), "segment_id").withColumnRenamed("rank", "place")


def tag_branch(queries: DataFrame, tags: DataFrame, n: int = 50) -> DataFrame:
    """(query_id, memory_id, tag, place): tags of the user's memories that hold the query, ignoring case. Texts
    are compared as they are, so no character is special; candidates come from the tags' pieces (`substrings`)."""
    # stored, as pieces, their counts and the memories read them, each of which would take the tags from their source again
    own = staged(tags.select("user_id", "tag", "memory_id").distinct(), "own-tags")
    found = substrings.holding(queries, substrings.postings(own, "user_id", "tag"), "user_id", "tag", "q")
    met = queries.select("query_id", "user_id", "q").join(found, ["user_id", "q"])
    rows = met.select("query_id", "user_id", "tag").join(own, ["user_id", "tag"])
    return _top(rows, ["tag", "memory_id"], n).select("query_id", "memory_id", "tag", "place")


def visual_branch(queries: DataFrame, frames: DataFrame, n: int = 50, scope: str | None = "user_id") -> DataFrame:
    """(query_id, memory_id, frame_id, distance, place): the nearest 25 n frames, each memory's best of them, and
    the n best memories."""
    near = embed.knn(queries, frames, 25 * n, key="frame_id", scope=scope).drop("rank").join(frames.select("frame_id", "memory_id"), "frame_id")
    best = near.groupBy("query_id", "memory_id").agg(F.min(F.struct("distance", "frame_id")).alias("b")).select("query_id", "memory_id", "b.frame_id", "b.distance")
    return _top(best, ["distance", "memory_id"], n)


def branch_ranks(rows: DataFrame) -> DataFrame:
    """(query_id, memory_id, rank) of the distinct memories of a branch, in order of their first place."""
    first = rows.groupBy("query_id", "memory_id").agg(F.min("place").alias("p"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("p"))).drop("p")


def rrf(branches: list[DataFrame], k: int = RRF_K, limit: int = 10) -> DataFrame:
    """(query_id, memory_id, score, place): reciprocal ranks summed over the branches; ties by id as text."""
    rows = branches[0]
    for b in branches[1:]:
        rows = rows.unionByName(b)
    # summed in order of rank, so that equal sets of ranks give equal scores
    total = rows.groupBy("query_id", "memory_id").agg(F.sort_array(F.collect_list(1 / (k + F.col("rank")))).alias("r"))
    scored = total.select("query_id", "memory_id", F.round(F.aggregate("r", F.lit(0.0), lambda a, x: a + x), 12).alias("score"))
    return _top(scored, [F.desc("score"), F.col("memory_id").cast("string")], limit)


def attach_evidence(hits: DataFrame, fts: DataFrame | None, vector: DataFrame | None, visual: DataFrame | None, tags: DataFrame | None, segments: DataFrame, frames: DataFrame | None) -> DataFrame:
    """Hits with `evidence`, an array of (type, snippet, start_ms, end_ms): the first full-text segment (else the
    first by vector), the frame, the tag; of equal types the first. Branches may be missing."""
    out = hits
    text = None
    for order, b in enumerate((fts, vector)):
        if b is not None:
            rows = b.select("query_id", "memory_id", F.struct(F.lit(order).alias("branch"), "place", "segment_id").alias("s"))
            text = rows if text is None else text.unionByName(rows)
    kind = F.struct(F.lit("").alias("type"), F.lit("").alias("snippet"), F.lit(0).alias("start_ms"), F.lit(0).alias("end_ms"))
    empty = F.lit(None).cast(hits.select(kind.alias("x")).schema["x"].dataType)
    if text is not None:
        first = hits.select("query_id", "memory_id").join(text, ["query_id", "memory_id"]).groupBy("query_id", "memory_id").agg(F.min("s").alias("s")).select("query_id", "memory_id", "s.segment_id")
        # stored, so that the planner knows how few they are: texts are then read past them and not shuffled, and each is cut once
        first = staged(first, "shown-segments")
        texts = first.select("segment_id").distinct().join(segments.select("segment_id", "modality", "content", "start_ms", "end_ms"), "segment_id")
        name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in EVIDENCE.items() for x in kv]), F.col("modality")), F.lit("TAG"))
        body = F.concat(F.when(F.col("modality") == "summary", F.lit("Summary: ")).otherwise(F.lit("")), snippet(F.col("content")))
        shown = first.join(texts.select("segment_id", F.struct(name.alias("type"), body.alias("snippet"), "start_ms", "end_ms").alias("__text")), "segment_id")
        out = out.join(shown.select("query_id", "memory_id", "__text"), ["query_id", "memory_id"], "left")
    else:
        out = out.withColumn("__text", empty)
    if visual is not None:
        best = visual.select("query_id", "memory_id", "frame_id").join(frames.select("frame_id", "timestamp_ms", "album_index"), "frame_id")
        out = out.join(best.select("query_id", "memory_id", F.struct(F.lit("VISUAL").alias("type"), visual_snippet(F.col("timestamp_ms"), F.col("album_index")).alias("snippet"), F.col("timestamp_ms").alias("start_ms"), F.lit(None).cast("int").alias("end_ms")).alias("__visual")), ["query_id", "memory_id"], "left")
    else:
        out = out.withColumn("__visual", empty)
    if tags is not None:
        first = tags.groupBy("query_id", "memory_id").agg(F.min_by("tag", "place").alias("tag"))
        out = out.join(first.select("query_id", "memory_id", F.struct(F.lit("TAG").alias("type"), F.concat(F.lit("Tag: "), "tag").alias("snippet"), F.lit(None).cast("int").alias("start_ms"), F.lit(None).cast("int").alias("end_ms")).alias("__tag")), ["query_id", "memory_id"], "left")
    else:
        out = out.withColumn("__tag", empty)
    t, v, g = F.col("__text"), F.col("__visual"), F.col("__tag")
    seen = F.coalesce(t["type"], F.lit(""))
    shown = F.array(t, F.when(seen != "VISUAL", v), F.when(seen != "TAG", g))
    return out.withColumn("evidence", F.filter(shown, lambda x: x.isNotNull())).drop("__text", "__visual", "__tag")


def assemble_hits(hits: DataFrame, memories: DataFrame, items: DataFrame) -> DataFrame:
    """Hits with title, summary, platform, creator, status and source_status; hits without a memory go, a missing
    item shows as ? and UNKNOWN; the title falls back to creator, then platform."""
    met = hits.join(memories.select("memory_id", "title", "summary", "status"), "memory_id").join(items.select("memory_id", "creator", "platform", "source_status"), "memory_id", "left")
    platform = F.coalesce("platform", F.lit("?"))
    title = F.coalesce(F.nullif(collapse(F.coalesce("title", F.lit(""))), F.lit("")), F.nullif("creator", F.lit("")), platform)
    return met.withColumns({"platform": platform, "source_status": F.coalesce("source_status", F.lit("UNKNOWN")), "display_title": title})


def hybrid_search(queries: DataFrame, memories: DataFrame, segments: DataFrame, tags: DataFrame, frames: DataFrame, index: DataFrame | None = None, analyzer: str = "simple", limit: int = 10, n: int = 50, with_vectors: bool = True, with_visual: bool = True, vectors: DataFrame | None = None) -> DataFrame:
    """Hits of every query with evidence and `degraded`: true when neither vector branch ran. `queries` have
    `embedding` for the segments' vectors and `visual` for the frames'. Everything is scoped to the query's user and to
    memories that search may return. Segments' vectors are their `embedding` or, beside them, `vectors` (segment_id, embedding)."""
    shown = visible(memories).select("memory_id", "user_id")
    seg = segments.drop("user_id").join(shown, "memory_id")
    index = textindex.build_index(seg, analyzer) if index is None else index
    # a branch is n rows a query, read for the ranks and again for the evidence: stored, so that it is searched once
    fts = staged(textindex.fts_branch(queries, seg, index, n, analyzer), "fts-branch")
    tagged = staged(tag_branch(queries, tags.drop("user_id").join(shown, "memory_id"), n), "tag-branch")
    with_own = seg if vectors is None else seg.join(vectors, "segment_id")
    vector = staged(vector_branch(queries, with_own, n), "vector-branch") if with_vectors else None
    own_frames = frames.join(shown, "memory_id")
    visual = staged(visual_branch(queries.drop("embedding").withColumnRenamed("visual", "embedding"), own_frames, n), "visual-branch") if with_visual else None
    hits = staged(rrf([branch_ranks(b) for b in (fts, vector, tagged, visual) if b is not None], limit=limit), "hits")
    # the branches hold only what is shown, so evidence is looked up in the whole tables, without that join
    return attach_evidence(hits, fts, vector, visual, tagged, segments, frames).withColumn("degraded", F.lit(not (with_vectors or with_visual)))


def retrieval_eval(hits: DataFrame, truth: DataFrame, at1: float = 0.80, at3: float = 0.90) -> DataFrame:
    """One row: n, recall_at_1, recall_at_3, misses (expected beyond place 3 or not found), passed. truth:
    (query_id, memory_id), any of which will do."""
    met = truth.join(hits.select("query_id", "memory_id", "place"), ["query_id", "memory_id"], "left").groupBy("query_id").agg(F.min("place").alias("place"))
    share = lambda k: F.round(F.avg(F.coalesce(F.col("place") <= k, F.lit(False)).cast("double")), 6)
    out = met.agg(F.count("*").alias("n"), share(1).alias("recall_at_1"), share(3).alias("recall_at_3"), F.count_if(~F.coalesce(F.col("place") <= 3, F.lit(False))).alias("misses"))
    return out.withColumn("passed", (F.col("recall_at_1") >= at1) & (F.col("recall_at_3") >= at3))


def latency_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, p50, p95, p95_low): the median, and the two floor-index percentiles int(n * .95) and
    int((n - 1) * .95). Null values take no part."""
    out = order_statistics(df, key, value, {"p50": median(), "p95": low_place(0.95), "p95_low": F.floor((F.col("n") - 1) * 0.95)})
    return out.withColumn("p50", F.round("p50", 6))


def leak_check(terms: DataFrame, segments: DataFrame) -> DataFrame:
    """(memory_id, term, leaked): whether a text of the memory holds the term, ignoring case."""
    met = terms.select("memory_id", "term").distinct().join(segments.select("memory_id", F.lower("content").alias("content")), "memory_id", "left")
    return met.groupBy("memory_id", "term").agg(F.coalesce(F.bool_or(F.contains("content", F.lower("term"))), F.lit(False)).alias("leaked"))


def recent_searches(log: DataFrame, n: int = 20) -> DataFrame:
    """(user_id, query, last_at, place): each user's newest distinct queries, normalized."""
    q = F.lower(collapse(F.col("q")))
    last = log.select("user_id", q.alias("query"), "ts").where("query <> ''").groupBy("user_id", "query").agg(F.max("ts").alias("last_at"))
    return _top(last, [F.desc("last_at"), "query"], n, "user_id")
