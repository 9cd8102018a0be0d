"""S1-S15 over documents, benchmark and embeddings.

Every benchmark item is asked by every user (source) as its first four words (s11: as its whole text and as its
first word), over that user's own segments; its vector for the visual branch is that of the embedding with its id.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import embed, search, textindex
from larder.plans.base import Plans, view
from larder.session import staged

plan = Plans()
USERS = 20
VECTOR_DIM = 256

_QS = f"""qs AS (SELECT item_id * {USERS} + u AS query_id, item_id, 'src' || CAST(u AS VARCHAR) AS user_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[1:4], ' ') AS q FROM (SELECT *, unnest(range({USERS})) AS u FROM benchmark))"""
_Q = f"""{_QS},
    shown AS (SELECT memory_id, user_id FROM memories_v WHERE status IN ('READY', 'METADATA_ONLY')),
    seg AS (SELECT s.* EXCLUDE (user_id), m.user_id FROM segments_v s JOIN shown m USING (memory_id)),
    toks AS (SELECT segment_id, CAST(pos - 1 AS INTEGER) AS pos, t[pos] AS lexeme FROM (SELECT segment_id, t, unnest(range(1, len(t) + 1)) AS pos FROM (SELECT segment_id, regexp_extract_all(lower(content), '[a-z0-9]+') AS t FROM seg))),
    terms AS (SELECT query_id, lexeme, count(*) OVER (PARTITION BY query_id) AS n_terms FROM (SELECT DISTINCT query_id, unnest(string_split(q, ' ')) AS lexeme FROM qs WHERE q <> ''))"""
_MATCH = f"""{_Q}, match AS (SELECT t.query_id, k.segment_id FROM terms t JOIN (SELECT DISTINCT segment_id, lexeme FROM toks) k USING (lexeme) JOIN seg USING (segment_id) JOIN qs ON qs.query_id = t.query_id AND qs.user_id = seg.user_id GROUP BY t.query_id, k.segment_id HAVING count(*) = max(n_terms))"""
_COVERS = """o AS (SELECT m.query_id, m.segment_id, k.pos, k.lexeme FROM match m JOIN terms t USING (query_id) JOIN toks k ON k.segment_id = m.segment_id AND k.lexeme = t.lexeme),
    l AS (SELECT query_id, segment_id, e, min(lp) AS b, count(*) AS k FROM (SELECT e.query_id, e.segment_id, e.pos AS e, p.lexeme, max(p.pos) AS lp FROM o e JOIN o p ON p.query_id = e.query_id AND p.segment_id = e.segment_id AND p.pos <= e.pos GROUP BY ALL) GROUP BY query_id, segment_id, e),
    c AS (SELECT query_id, segment_id, b, min(e) AS e FROM l WHERE k = (SELECT max(n_terms) FROM terms t WHERE t.query_id = l.query_id) GROUP BY query_id, segment_id, b),
    ranks AS (SELECT query_id, segment_id, round(sum(0.1 / (1 + (e - b) - ((SELECT count(*) FROM o WHERE o.query_id = c.query_id AND o.segment_id = c.segment_id AND o.pos BETWEEN c.b AND c.e) - 1))), 9) AS rank FROM c GROUP BY query_id, segment_id)"""
_RANK = f"""{_MATCH}, {_COVERS},
    fts AS (SELECT query_id, memory_id, segment_id, rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, memory_id, segment_id) AS INTEGER) AS place FROM ranks JOIN seg USING (segment_id) QUALIFY place <= 50)"""
_TAGS = """tq AS (SELECT query_id, user_id, string_split(q, ' ')[1] AS q FROM qs WHERE q <> ''),
    tags AS (SELECT DISTINCT t.memory_id, m.user_id, t.tag FROM tags_v t JOIN shown m USING (memory_id)),
    tagb AS (SELECT query_id, memory_id, tag, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tag, memory_id) AS INTEGER) AS place FROM tq JOIN tags ON tq.user_id = tags.user_id AND contains(lower(tag), lower(q)) QUALIFY place <= 50)"""
_VISUAL = """fr AS (SELECT f.*, m.user_id FROM frames_v f JOIN shown m USING (memory_id)),
    near AS (SELECT query_id, frame_id, memory_id, round(1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(fr.embedding AS DOUBLE[])), 6) AS distance FROM qs JOIN embeddings e ON e.vec_id = qs.item_id JOIN fr ON fr.user_id = qs.user_id),
    n25 AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, frame_id) <= 1250),
    vis AS (SELECT query_id, memory_id, b.frame_id AS frame_id, b.distance AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY b.distance, memory_id) AS INTEGER) AS place FROM (SELECT query_id, memory_id, min({'distance': distance, 'frame_id': frame_id}) AS b FROM n25 GROUP BY ALL) QUALIFY place <= 50)"""
_FUSED = f"""{_RANK}, {_TAGS}, {_VISUAL},
    br AS (SELECT query_id, memory_id, row_number() OVER (PARTITION BY b, query_id ORDER BY p) AS r FROM (SELECT 1 AS b, query_id, memory_id, min(place) AS p FROM fts GROUP BY ALL UNION ALL SELECT 2, query_id, memory_id, min(place) FROM tagb GROUP BY ALL UNION ALL SELECT 3, query_id, memory_id, min(place) FROM vis GROUP BY ALL)),
    hits AS (SELECT query_id, memory_id, round(list_sum(list(1 / CAST(60 + r AS DOUBLE) ORDER BY r DESC)), 12) AS score FROM br GROUP BY ALL),
    top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(memory_id AS VARCHAR)) AS INTEGER) AS place FROM hits QUALIFY place <= 10)"""
_EVIDENCE = f"""{_FUSED},
    t1 AS (SELECT query_id, memory_id, CASE modality WHEN 'speech' THEN 'SPEECH' WHEN 'ocr' THEN 'OCR' WHEN 'visual' THEN 'VISUAL' WHEN 'caption' THEN 'CAPTION' ELSE 'TAG' END AS type, CASE WHEN modality = 'summary' THEN 'Summary: ' ELSE '' END || CASE WHEN length(x) > 200 THEN rtrim(substr(x, 1, 200)) || '…' ELSE x END AS snippet
        FROM (SELECT f.query_id, f.memory_id, arg_min(f.segment_id, f.place) AS segment_id FROM fts f GROUP BY ALL) JOIN (SELECT segment_id, modality, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS x FROM seg) USING (segment_id)),
    v1 AS (SELECT query_id, vis.memory_id, CASE WHEN album_index IS NOT NULL THEN 'Visual match: photo ' || CAST(album_index + 1 AS VARCHAR) ELSE 'Visual match near 0:' || lpad(CAST(timestamp_ms // 1000 AS VARCHAR), 2, '0') END AS snippet FROM vis JOIN fr USING (frame_id)),
    g1 AS (SELECT query_id, memory_id, 'Tag: ' || arg_min(tag, place) AS snippet FROM tagb GROUP BY ALL),
    shownhits AS (SELECT top.*, concat_ws('|', t1.type || '=' || t1.snippet, CASE WHEN coalesce(t1.type, '') <> 'VISUAL' THEN 'VISUAL=' || v1.snippet END, CASE WHEN coalesce(t1.type, '') <> 'TAG' THEN 'TAG=' || g1.snippet END) AS evidence
        FROM top LEFT JOIN t1 USING (query_id, memory_id) LEFT JOIN v1 USING (query_id, memory_id) LEFT JOIN g1 USING (query_id, memory_id))"""


# s11: whole texts and first words in place of the four words, which the tag branch then asks too, and a branch by hashed vectors
_QS_WHOLE = f"""qs AS (SELECT 2 * (item_id * {USERS} + u) + short AS query_id, item_id, 'src' || CAST(u AS VARCHAR) AS user_id, CASE short WHEN 0 THEN coalesce(text, '') ELSE coalesce(regexp_extract(lower(text), '[a-z0-9]+'), '') END AS q FROM (SELECT *, unnest(range({USERS})) AS u FROM benchmark), (VALUES (0), (1)) w(short))"""
# the same covers with each term's last hit by a window, as one word in a long text has too many hits to pair
_COVERS_WHOLE = """o AS (SELECT m.query_id, m.segment_id, k.lexeme, {'i': row_number() OVER (PARTITION BY m.query_id, m.segment_id ORDER BY k.pos), 'pos': k.pos} AS h FROM match m JOIN terms t USING (query_id) JOIN toks k ON k.segment_id = m.segment_id AND k.lexeme = t.lexeme),
    l AS (SELECT query_id, segment_id, e, min(lp) AS b, count(lp) AS k FROM (SELECT o.query_id, o.segment_id, o.h AS e, max(CASE WHEN o.lexeme = t.lexeme THEN o.h END) OVER (PARTITION BY o.query_id, o.segment_id, t.lexeme ORDER BY o.h.i) AS lp FROM o JOIN terms t USING (query_id)) GROUP BY ALL),
    c AS (SELECT query_id, segment_id, b, min(e) AS e FROM l JOIN (SELECT DISTINCT query_id, n_terms FROM terms) USING (query_id) WHERE k = n_terms GROUP BY ALL),
    ranks AS (SELECT query_id, segment_id, round(sum(0.1 / (1 + (e.pos - b.pos) - (e.i - b.i))), 9) AS rank FROM c GROUP BY ALL)"""
_HASHED = f"""texts AS (SELECT row_number() OVER () AS text_id, t FROM (SELECT DISTINCT q AS t FROM qs UNION SELECT content FROM seg)),
    chars AS (SELECT text_id, unnest(c) AS c, unnest(range(len(c))) AS i FROM (SELECT text_id, string_split(lower(' ' || t || ' '), '') AS c FROM texts)),
    pieces AS (SELECT text_id, c || lead(c) OVER w || lead(c, 2) OVER w AS g3, lead(c, 3) OVER w AS c4, lead(c, 4) OVER w AS c5 FROM chars WINDOW w AS (PARTITION BY text_id ORDER BY i)),
    gram AS (SELECT text_id, g, count(*) AS n FROM (SELECT text_id, g3 AS g FROM pieces UNION ALL SELECT text_id, g3 || c4 FROM pieces UNION ALL SELECT text_id, g3 || c4 || c5 FROM pieces) WHERE g IS NOT NULL GROUP BY ALL),
    place_of AS (SELECT g, CAST(('0x' || md5(g))::UHUGEINT % {VECTOR_DIM} AS BIGINT) AS b FROM (SELECT DISTINCT g FROM gram)),
    bucket AS (SELECT text_id, b, sum(n) AS n FROM gram JOIN place_of USING (g) GROUP BY ALL),
    weight AS (SELECT text_id, b, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY text_id)) AS FLOAT) AS w FROM bucket),
    vec AS (SELECT t, list(CAST(coalesce(w, 0) AS DOUBLE) ORDER BY d.b) AS v FROM (SELECT DISTINCT text_id FROM weight) JOIN texts USING (text_id) CROSS JOIN (SELECT unnest(range({VECTOR_DIM})) AS b) d LEFT JOIN weight USING (text_id, b) GROUP BY t),
    vdist AS (SELECT query_id, segment_id, memory_id, round(1 - list_cosine_similarity(a.v, b.v), 6) AS distance FROM qs JOIN vec a ON a.t = qs.q JOIN seg ON seg.user_id = qs.user_id JOIN vec b ON b.t = seg.content),
    vecb AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, segment_id) AS INTEGER) AS place FROM vdist QUALIFY place <= 50)"""


def _hybrid_sql() -> str:
    """s9's SQL with the vector branch in its place, second of the texts that show evidence."""
    sql = _EVIDENCE.replace(_QS, _QS_WHOLE).replace(_COVERS, _COVERS_WHOLE)
    sql = sql.replace("unnest(string_split(q, ' ')) AS lexeme FROM qs WHERE q <> ''", "unnest(regexp_extract_all(lower(q), '[a-z0-9]+')) AS lexeme FROM qs")
    sql = sql.replace("tq AS (SELECT query_id, user_id, string_split(q, ' ')[1] AS q FROM", "tq AS (SELECT query_id, user_id, q FROM")
    sql = sql.replace("br AS (SELECT", f"{_HASHED}, br AS (SELECT").replace(" UNION ALL SELECT 2, query_id", " UNION ALL SELECT 4, query_id, memory_id, min(place) FROM vecb GROUP BY ALL UNION ALL SELECT 2, query_id")
    first = "arg_min(f.segment_id, f.place) AS segment_id FROM fts f GROUP BY ALL"
    both = "min({'branch': branch, 'place': place, 'segment_id': segment_id}).segment_id AS segment_id FROM (SELECT 0 AS branch, query_id, memory_id, place, segment_id FROM fts UNION ALL SELECT 1, query_id, memory_id, place, segment_id FROM vecb) f GROUP BY ALL"
    return f"WITH {sql.replace(first, both)} SELECT *, false AS degraded FROM shownhits"


def _queries(spark, sf_dir):
    b = view(spark, sf_dir, "benchmark").select("item_id", "text", F.explode(F.sequence(F.lit(0), F.lit(USERS - 1))).alias("u"))
    q = F.array_join(F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0), 1, 4), " ")
    return b.select((F.col("item_id") * USERS + F.col("u")).alias("query_id"), "item_id", F.concat(F.lit("src"), F.col("u").cast("string")).alias("user_id"), q.alias("q"))


def _with_visual(spark, sf_dir):
    e = view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("visual"))
    return _queries(spark, sf_dir).join(e, "item_id", "left")


def _whole_queries(spark, sf_dir):
    first = F.regexp_extract(F.lower("text"), "[a-z0-9]+", 0)
    texts = view(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.array(F.coalesce("text", F.lit("")), F.coalesce(first, F.lit("")))).alias("short", "whole"))
    asked = _with_visual(spark, sf_dir).drop("q").join(texts, "item_id")
    return asked.withColumn("query_id", 2 * F.col("query_id") + F.col("short")).withColumnRenamed("whole", "q").drop("short")


def _shown(spark, sf_dir):
    return search.visible(view(spark, sf_dir, "memories_v")).select("memory_id", "user_id")


def _segments(spark, sf_dir):
    return view(spark, sf_dir, "segments_v").drop("user_id").join(_shown(spark, sf_dir), "memory_id")


def _frames(spark, sf_dir):
    return view(spark, sf_dir, "frames_v").join(_shown(spark, sf_dir), "memory_id")


def _index(seg):
    """The index as the stored table that it is: built once, read by each step."""
    return staged(textindex.build_index(seg), "index")


def _tags(spark, sf_dir):
    return view(spark, sf_dir, "tags_v").drop("user_id").join(_shown(spark, sf_dir), "memory_id")


def _tag_queries(spark, sf_dir):
    return _queries(spark, sf_dir).withColumn("q", F.split("q", " ")[0])


@plan("SELECT doc_id AS segment_id, lexeme, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions, CAST(count(*) AS INTEGER) AS tf FROM (SELECT doc_id, pos - 1 AS pos, t[pos] AS lexeme FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents))) GROUP BY ALL")
def s1_build_index(spark, sf_dir):
    return textindex.build_index(view(spark, sf_dir, "segments_v")).drop("first", "last").withColumn("positions", F.array_join(F.transform("positions", lambda p: p.cast("string")), ","))


@plan()
def s1_english_index(spark, sf_dir):
    return textindex.build_index(view(spark, sf_dir, "segments_v"), "english")


@plan(f"WITH {_MATCH} SELECT * FROM match")
def s2_fts_match(spark, sf_dir):
    seg = _segments(spark, sf_dir)
    return textindex.fts_match(_queries(spark, sf_dir), _index(seg), owners=seg.select("segment_id", "user_id"))


@plan(f"WITH {_RANK} SELECT * FROM ranks")
def s3_fts_rank(spark, sf_dir):
    seg, q = _segments(spark, sf_dir), _queries(spark, sf_dir)
    index = _index(seg)
    return textindex.fts_rank(textindex.fts_match(q, index, owners=seg.select("segment_id", "user_id")), q, index)


@plan(f"WITH {_RANK} SELECT query_id, memory_id, segment_id, rank, place FROM fts")
def s4_fts_branch(spark, sf_dir):
    seg = _segments(spark, sf_dir)
    return textindex.fts_branch(_queries(spark, sf_dir), seg, _index(seg))


@plan(f"""WITH {_MATCH}, heads AS (SELECT segment_id, lexeme, count(*) AS tf, min(pos) AS first, max(pos) AS last FROM toks GROUP BY ALL),
    b AS (SELECT query_id, segment_id, count(*) AS n, sum(tf) AS hits, min(tf) AS fewest, max(first) - min(last) AS apart, least(max(first) - min(first), max(last) - min(last)) + 1 - count(*) AS shortest FROM match JOIN terms USING (query_id) JOIN heads USING (segment_id, lexeme) GROUP BY ALL),
    e AS (SELECT query_id, round(CASE WHEN n = 1 THEN 0.1 * hits ELSE 0.1 / CAST(1 + greatest(0, shortest) AS DOUBLE) END, 9) AS least, round(0.1 * least(n * fewest, hits - n + 1) / CAST(1 + greatest(0, apart + 1 - hits) AS DOUBLE), 9) AS most FROM b),
    c AS (SELECT *, list(least) OVER (PARTITION BY query_id ORDER BY least DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)[10] AS bar FROM e)
    SELECT query_id, count(*) AS matches, count(*) FILTER (WHERE bar IS NULL OR most > bar - 2e-9) AS ranked FROM c GROUP BY query_id""")
def s4_pruning(spark, sf_dir):
    """How many matches of a query are ranked for its ten best."""
    seg = _segments(spark, sf_dir)
    met = textindex.fts_hopeful(_queries(spark, sf_dir), seg, _index(seg), 10)
    return met.groupBy("query_id").agg(F.count("*").alias("matches"), F.count_if("hopeful").alias("ranked"))


@plan(f"WITH {_Q}, {_TAGS} SELECT * FROM tagb")
def s5_tag_branch(spark, sf_dir):
    return search.tag_branch(_tag_queries(spark, sf_dir), _tags(spark, sf_dir))


@plan(f"WITH {_Q}, {_VISUAL} SELECT * FROM vis")
def s6_visual_branch(spark, sf_dir):
    q = _with_visual(spark, sf_dir).withColumnRenamed("visual", "embedding")
    return search.visual_branch(q, _frames(spark, sf_dir))


@plan(f"WITH {_RANK} SELECT query_id, memory_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p) AS INTEGER) AS rank FROM (SELECT query_id, memory_id, min(place) AS p FROM fts GROUP BY ALL)")
def s7_branch_ranks(spark, sf_dir):
    return search.branch_ranks(s4_fts_branch(spark, sf_dir))


def _branches(spark, sf_dir):
    """Stored, as their ranks and their evidence both read them."""
    return tuple(staged(b(spark, sf_dir), "branch") for b in (s4_fts_branch, s5_tag_branch, s6_visual_branch))


@plan(f"WITH {_FUSED} SELECT * FROM top")
def s8_rrf(spark, sf_dir):
    return search.rrf([search.branch_ranks(b) for b in _branches(spark, sf_dir)])


def _flat(hits):
    return hits.withColumn("evidence", F.array_join(F.transform("evidence", lambda e: F.concat(e["type"], F.lit("="), e["snippet"])), "|"))


@plan(f"WITH {_EVIDENCE} SELECT * FROM shownhits")
def s9_attach_evidence(spark, sf_dir):
    fts, tags, visual = _branches(spark, sf_dir)
    hits = search.rrf([search.branch_ranks(b) for b in (fts, tags, visual)])
    return _flat(search.attach_evidence(hits, fts, None, visual, tags, _segments(spark, sf_dir), _frames(spark, sf_dir)))


@plan(f"""WITH {_FUSED}, i AS (SELECT memory_id, CASE WHEN memory_id % 2 = 0 THEN 'by' || CAST(memory_id AS VARCHAR) END AS creator, 'youtube' AS platform, 'OK' AS source_status FROM memories_v WHERE memory_id % 3 > 0)
    SELECT top.query_id, top.memory_id, top.place, coalesce(platform, '?') AS platform, coalesce(source_status, 'UNKNOWN') AS source_status, m.status,
        coalesce(nullif(CASE WHEN m.memory_id % 4 = 0 THEN '' ELSE trim(regexp_replace(m.title, '\\s+', ' ', 'g')) END, ''), creator, platform, '?') AS display_title FROM top JOIN memories_v m USING (memory_id) LEFT JOIN i USING (memory_id)""")
def s10_assemble_hits(spark, sf_dir):
    m = view(spark, sf_dir, "memories_v").withColumns({"title": F.expr("CASE WHEN memory_id % 4 = 0 THEN '' ELSE title END"), "summary": F.lit("")})
    items = m.where("memory_id % 3 > 0").select("memory_id", F.expr("CASE WHEN memory_id % 2 = 0 THEN 'by' || cast(memory_id AS string) END").alias("creator"), F.lit("youtube").alias("platform"), F.lit("OK").alias("source_status"))
    return search.assemble_hits(s8_rrf(spark, sf_dir), m, items).select("query_id", "memory_id", "place", "platform", "source_status", "status", "display_title")


@plan(_hybrid_sql())
def s11_hybrid_search(spark, sf_dir):
    """All four branches: text and vectors of segments, tags, frames. Every user asks each item twice: as its whole
    text (even ids), and as its first word (odd ids), as tags are words."""
    q, seg = _whole_queries(spark, sf_dir), view(spark, sf_dir, "segments_v")
    shown = _segments(spark, sf_dir)
    index = _index(shown)
    # vectors are stored tables too: embedded once, then read by the branch and by its joins
    vectors = staged(embed.hash_embed(shown, "segment_id", "content", VECTOR_DIM), "segment-vectors")
    q = staged(q.join(embed.hash_embed(q, "query_id", "q", VECTOR_DIM), "query_id"), "query-vectors")
    hits = search.hybrid_search(q, view(spark, sf_dir, "memories_v"), seg, view(spark, sf_dir, "tags_v"), view(spark, sf_dir, "frames_v"), index, vectors=vectors)
    return _flat(hits)


_TRUTH = "truth AS (SELECT qs.query_id, seg.memory_id FROM qs JOIN benchmark b USING (item_id) JOIN seg ON seg.user_id = qs.user_id AND contains(seg.content, b.text))"


@plan(f"""WITH {_RANK}, {_TRUTH}, p AS (SELECT t.query_id, min(f.place) AS place FROM truth t LEFT JOIN fts f USING (query_id, memory_id) GROUP BY t.query_id),
    a AS (SELECT count(*) AS n, round(avg(CASE WHEN place <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1, round(avg(CASE WHEN place <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_3, count(*) FILTER (WHERE NOT coalesce(place <= 3, false)) AS misses FROM p)
    SELECT *, recall_at_1 >= 0.80 AND recall_at_3 >= 0.90 AS passed FROM a""")
def s12_retrieval_eval(spark, sf_dir):
    q, seg = _queries(spark, sf_dir), _segments(spark, sf_dir)
    index = _index(seg)
    asked = q.join(view(spark, sf_dir, "benchmark"), "item_id")
    truth = textindex.segments_holding(asked, seg, index).join(seg.select("segment_id", "memory_id"), "segment_id").select("query_id", "memory_id")
    return search.retrieval_eval(textindex.fts_branch(q, seg, index), truth)


@plan("""SELECT event_type, n, round(p50, 6) AS p50, max(v) FILTER (WHERE i = least(n - 1, CAST(floor(n * 0.95) AS BIGINT))) AS p95, max(v) FILTER (WHERE i = CAST(floor((n - 1) * 0.95) AS BIGINT)) AS p95_low
    FROM (SELECT event_type, value AS v, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, quantile_cont(value, 0.5) OVER (PARTITION BY event_type) AS p50 FROM events) GROUP BY event_type, n, p50""")
def s13_latency_stats(spark, sf_dir):
    return search.latency_stats(view(spark, sf_dir, "events"), "event_type", "value")


@plan("""WITH t AS (SELECT DISTINCT memory_id + memory_id % 2 AS memory_id, tag AS term FROM tags_v) SELECT t.memory_id, term, coalesce(bool_or(contains(lower(content), lower(term))), false) AS leaked FROM t LEFT JOIN segments_v s ON s.memory_id = t.memory_id GROUP BY ALL""")
def s14_leak_check(spark, sf_dir):
    t = view(spark, sf_dir, "tags_v").select((F.col("memory_id") + F.col("memory_id") % 2).alias("memory_id"), F.col("tag").alias("term"))
    return search.leak_check(t, view(spark, sf_dir, "segments_v"))


@plan("""WITH l AS (SELECT user_id, lower(trim(regexp_replace(' ' || event_type || '   ' || props || ' ', '\\s+', ' ', 'g'))) AS query, max(ts) AS last_at FROM events GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY last_at DESC, query) AS INTEGER) AS place FROM l QUALIFY place <= 20""")
def s15_recent_searches(spark, sf_dir):
    return search.recent_searches(view(spark, sf_dir, "events").select("user_id", "ts", F.expr("' ' || event_type || '   ' || props || ' '").alias("q")))
