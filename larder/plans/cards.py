"""M1-M9 over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import cards
from larder.plans.base import Plans, view
from larder.plans.extract import _LEAD

plan = Plans()
_STOP = ", ".join(f"'{w}'" for w in cards.STOPWORDS)


def _segments(spark, sf_dir):
    return view(spark, sf_dir, "segments_v").withColumn("album_index", F.expr("CASE WHEN segment_id % 4 = 0 THEN cast(segment_id % 3 AS int) END")).withColumn("start_ms", F.expr("CASE WHEN segment_id % 8 <> 0 THEN start_ms END"))


_SEGMENTS = "s AS (SELECT * REPLACE (CASE WHEN segment_id % 8 <> 0 THEN start_ms END AS start_ms), CASE WHEN segment_id % 4 = 0 THEN CAST(segment_id % 3 AS INT) END AS album_index FROM segments_v)"
_LABEL = "'[' || modality || CASE WHEN album_index IS NOT NULL THEN ' photo ' || CAST(album_index + 1 AS VARCHAR) ELSE '' END || CASE WHEN start_ms IS NULL THEN '' WHEN end_ms <> 0 AND end_ms <> start_ms THEN ' @ ' || CAST(start_ms // 1000 AS VARCHAR) || 's-' || CAST(end_ms // 1000 AS VARCHAR) || 's' ELSE ' @ ' || CAST(start_ms // 1000 AS VARCHAR) || 's' END || ']'"


@plan(f"""WITH w AS (SELECT memory_id, list_position(['speech', 'visual', 'ocr', 'caption'], modality) AS m, segment_id, unnest(range(len(t))) AS pos, unnest(t) AS tag
        FROM (SELECT *, regexp_extract_all(lower(content), '[a-z0-9][a-z0-9''_-]*') AS t FROM segments_v WHERE modality IN ('speech', 'visual', 'ocr', 'caption'))),
    c AS (SELECT memory_id, tag, count(*) AS n, min((m, segment_id, pos)) AS first FROM w WHERE length(tag) > 2 AND tag NOT IN ({_STOP}) GROUP BY ALL)
    SELECT memory_id, tag, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY n DESC, first) AS r FROM c) WHERE r <= 8""")
def m1_keyword_tags(spark, sf_dir):
    return cards.keyword_tags(view(spark, sf_dir, "segments_v"))


_CASES = " ".join(f"WHEN {' OR '.join(f'''contains(t, '{w}')''' for w in words)} THEN '{name}'" for name, words in cards.FLAT_CATEGORIES.items())


@plan(f"SELECT doc_id, CASE {_CASES} ELSE 'Other' END AS category FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def m2_flat_category(spark, sf_dir):
    return cards.flat_category(view(spark, sf_dir, "documents"), "text").select("doc_id", "category")


@plan(r"""WITH g AS (SELECT memory_id, count(*) FILTER (WHERE modality = 'speech') AS ns, count(*) FILTER (WHERE modality = 'visual') AS nv, count(*) FILTER (WHERE modality = 'ocr') AS no,
        arg_min(content, segment_id) FILTER (WHERE modality = 'speech') AS speech, arg_min(content, segment_id) FILTER (WHERE modality = 'visual') AS visual, arg_min(content, segment_id) FILTER (WHERE modality = 'caption') AS caption FROM segments_v GROUP BY memory_id)
    SELECT memory_id, coalesce(nullif(substr(string_split(regexp_replace(coalesce(CASE WHEN nv > 0 THEN visual WHEN ns > 0 THEN speech ELSE caption END, ''), '^\s+|\s+$', '', 'g'), chr(10))[1], 1, 120), ''), 'Untitled memory') AS title,
        'Saved reel memory (' || coalesce(nullif(concat_ws('; ', CASE WHEN ns > 0 THEN CAST(ns AS VARCHAR) || ' speech segments' END, CASE WHEN nv > 0 THEN CAST(nv AS VARCHAR) || ' visual observations' END, CASE WHEN no > 0 THEN CAST(no AS VARCHAR) || ' on-screen text segments' END), ''), 'no modality evidence extracted') || ').' ||
        CASE WHEN coalesce(speech, '') <> '' THEN ' Opens with: ' || substr(regexp_replace(speech, '^\s+|\s+$', '', 'g'), 1, 200) ELSE '' END AS summary FROM g""")
def m3_build_cards(spark, sf_dir):
    return cards.build_cards(view(spark, sf_dir, "segments_v"))


@plan(rf"""SELECT doc_id, substr(CASE WHEN doc_id % 3 = 0 THEN 'https://p/' || CAST(doc_id AS VARCHAR) ELSE lang || ' page' END, 1, 200) AS title,
    {_LEAD.replace('400', '2000').replace('> 200 ', '> 1000 ')} AS summary, 'article' AS media_kind, substr(t, 1, 20000) AS content
    FROM (SELECT doc_id, lang, t, substr(t, 1, 2000) AS cut FROM (SELECT doc_id, lang, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents))""")
def m4_article_cards(spark, sf_dir):
    d = view(spark, sf_dir, "documents").withColumns({"title": F.expr("CASE WHEN doc_id % 3 <> 0 THEN lang || ' page' END"), "url": F.expr("'https://p/' || cast(doc_id AS string)")})
    return cards.build_article_cards(d, "doc_id", "title", "url", "text")


_HEADS = " ".join(f"WHEN '{m}' THEN '{h}'" for m, h in cards.EVIDENCE_NAMES.items())


@plan(f"""WITH {_SEGMENTS}, r AS (SELECT memory_id, modality, segment_id, {_LABEL} || ' "' || substr(content, 1, 500) || '"' AS line, row_number() OVER (PARTITION BY memory_id, modality ORDER BY segment_id) AS n FROM s WHERE modality <> 'summary'),
    b AS (SELECT memory_id, modality, CASE modality {_HEADS} END || ':' || chr(10) || string_agg(line, chr(10) ORDER BY n) AS block FROM r WHERE n <= 60 GROUP BY memory_id, modality)
    SELECT memory_id, string_agg(block, chr(10) || chr(10) ORDER BY list_position(['speech', 'visual', 'ocr', 'caption', 'article'], modality)) AS evidence FROM b GROUP BY memory_id""")
def m5_evidence_text(spark, sf_dir):
    return cards.evidence_text(_segments(spark, sf_dir))


@plan(f"WITH {_SEGMENTS} SELECT segment_id, {_LABEL} AS label FROM s")
def m6_evidence_label(spark, sf_dir):
    return _segments(spark, sf_dir).select("segment_id", cards.evidence_label(F.col("modality"), F.col("start_ms"), F.col("end_ms"), F.col("album_index")).alias("label"))


_ITEMS = "SELECT DISTINCT memory_id, CASE WHEN memory_id % 3 = 0 THEN 'by' || cast(memory_id AS string) END AS creator, CASE WHEN memory_id % 4 = 0 THEN 'cap ' || cast(memory_id AS string) END AS caption FROM segments_v"


@plan(f"""WITH {_SEGMENTS}, i AS ({_ITEMS}), r AS (SELECT memory_id, modality, '[' || CAST(coalesce(start_ms, 0) // 1000 AS VARCHAR) || 's] ' || content AS line, row_number() OVER (PARTITION BY memory_id, modality ORDER BY segment_id) AS n FROM s),
    b AS (SELECT memory_id, modality, CASE modality WHEN 'speech' THEN 'SPOKEN AUDIO' WHEN 'visual' THEN 'FRAMES SEEN' ELSE 'ON-SCREEN TEXT' END || ':' || chr(10) || string_agg(line, chr(10) ORDER BY n) AS block FROM r WHERE modality IN ('speech', 'visual', 'ocr') AND n <= CASE modality WHEN 'speech' THEN 40 ELSE 20 END GROUP BY memory_id, modality),
    g AS (SELECT memory_id, string_agg(block, chr(10) || chr(10) ORDER BY list_position(['speech', 'visual', 'ocr'], modality)) AS text FROM b GROUP BY memory_id)
    SELECT i.memory_id, coalesce(nullif(concat_ws(chr(10) || chr(10), g.text, CASE WHEN creator IS NOT NULL OR caption IS NOT NULL THEN 'POST METADATA:' || chr(10) || 'creator=' || coalesce(creator, 'unknown') || chr(10) || 'caption=' || coalesce(caption, '') END), ''), '(no evidence captured)') AS evidence
    FROM i LEFT JOIN g USING (memory_id)""")
def m7_generator_evidence(spark, sf_dir):
    s = _segments(spark, sf_dir)
    view(spark, sf_dir, "segments_v").createOrReplaceTempView("segments_v")
    return cards.generator_evidence(s, spark.sql(_ITEMS))


_CITES = "SELECT segment_id AS citation_id, memory_id, CASE WHEN segment_id % 5 = 0 THEN 'ocr' ELSE modality END AS modality, CASE WHEN segment_id % 3 = 0 THEN 'not there ' || cast(segment_id AS string) ELSE substring(content, 5, 12) END AS quote FROM segments_v"


@plan(f"WITH c AS ({_CITES}) SELECT citation_id, EXISTS (SELECT 1 FROM segments_v s WHERE s.memory_id = c.memory_id AND s.modality = c.modality AND contains(s.content, c.quote)) AS grounded FROM c")
def m8_check_citations(spark, sf_dir):
    s = view(spark, sf_dir, "segments_v")
    s.createOrReplaceTempView("segments_v")
    return cards.check_citations(spark.sql(_CITES), s)


@plan("""SELECT conv_id, CAST(pos - 1 AS INTEGER) AS pos, claims[pos] AS claim FROM (SELECT conv_id, claims, unnest(range(1, least(len(claims), 5) + 1)) AS pos FROM (
    SELECT conv_id, list_filter(list(text ORDER BY turn), lambda x: x <> '') AS claims FROM conversations GROUP BY conv_id))""")
def m9_claims_to_verify(spark, sf_dir):
    turns = view(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.col("text").alias("c")))), lambda x: x["c"]).alias("claims"))
    return cards.claims_to_verify(turns, "conv_id", "claims")


@plan("""SELECT claim_id, CAST(n AS INTEGER) AS n, url, title FROM (SELECT page_id // 6 AS claim_id, url, 't' AS title, row_number() OVER (PARTITION BY page_id // 6 ORDER BY page_id % 6, url) AS n FROM pages WHERE url LIKE 'http://%' OR url LIKE 'https://%') WHERE n <= 3""")
def m9_claim_sources(spark, sf_dir):
    found = view(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 6).alias("claim_id"), (F.col("page_id") % 6).alias("rank"), "url", F.lit("t").alias("title"))
    return cards.claim_sources(found)


@plan("SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS supported, count(*) FILTER (WHERE role = 'assistant') AS contradicted, count(*) FILTER (WHERE role NOT IN ('user', 'assistant')) AS uncertain FROM conversations GROUP BY conv_id")
def m9_verdict_summary(spark, sf_dir):
    v = F.when(F.col("role") == "user", "Supported").when(F.col("role") == "assistant", "contradicted").otherwise(F.lit("?"))
    return cards.verdict_summary(view(spark, sf_dir, "conversations").withColumn("verdict", v), "conv_id")
