"""X1-X12 over pages, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import text as T
from larder.operators import extract
from larder.plans.base import Plans, view

plan = Plans()


@plan()
def x1_extract_articles(spark, sf_dir):
    return extract.extract_articles(view(spark, sf_dir, "pages"))


_OG = """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '' ELSE '<META  property="OG:title" x content="' || CASE WHEN page_id % 3 = 0 THEN 'Home > ' ELSE '' END || url || '"><meta content=''c' || CASE WHEN page_id % 4 = 1 THEN ' -> ' ELSE '' END || '' || cast(page_id AS string) || ''' property="og:description"/>' || CASE WHEN page_id % 2 = 0 THEN '<meta property="og:image" content=""><meta property="og:image:secure_url" content="https://i/' || cast(page_id AS string) || '">' ELSE '' END || '<meta property="og:title" content="second">' END || html AS html FROM pages"""


@plan(r"""WITH h AS (SELECT page_id, html FROM (""" + _OG + r""")),
    cut AS (SELECT page_id, string_split_regex(html, '(?i)<meta\s')[2:] AS pieces FROM h),
    said AS (SELECT page_id, i, lower(regexp_extract(piece, '(?i)property=["''](og:[a-z_:]+)["'']', 1)) AS n, regexp_extract(piece, '(?i)content=["'']([^"'']*)["'']', 1) AS v, strpos(lower(piece), 'content=') AS at_content, strpos(lower(piece), 'property=') AS at_property
        FROM (SELECT page_id, i, pieces[i] AS piece FROM cut, unnest(range(1, len(pieces) + 1)) AS u(i))),
    og AS (SELECT page_id, list([n, v] ORDER BY at_content < at_property, i) AS kv FROM said WHERE n <> '' AND at_content > 0 GROUP BY page_id),
    v AS (SELECT page_id, substr(nullif(list_filter(kv, lambda x: x[1] = 'og:title')[1][2], ''), 1, 128) AS creator, substr(nullif(list_filter(kv, lambda x: x[1] = 'og:description')[1][2], ''), 1, 10000) AS caption,
        coalesce(nullif(list_filter(kv, lambda x: x[1] = 'og:image')[1][2], ''), nullif(list_filter(kv, lambda x: x[1] = 'og:image:secure_url')[1][2], '')) AS thumbnail FROM og)
    SELECT * FROM v WHERE coalesce(creator, caption, thumbnail) IS NOT NULL""")
def x2_extract_og(spark, sf_dir):
    view(spark, sf_dir, "shared_v")
    return extract.extract_og(spark.sql(_OG))


_SRT = """SELECT doc_id, '1' || chr(13) || chr(10) || '00:00:0' || cast(doc_id % 9 AS string) || ',32 --> 00:00:04,960' || chr(10) || '<i>' || replace(text, chr(10), ' ') || '</i>' || chr(10) || '  ' || chr(10) || '2' || chr(10) || '00:01:05.5  --> 00:01:07.250 x' || chr(10) || ' a  b ' || chr(10) || 'c' || chr(10) || chr(10) || 'no arrow' || chr(10) || chr(10) || '3' || chr(10) || '0:02:00,1 --> bad' || chr(10) || 't' || chr(10) || chr(10) || '01:00:00,001 --> 01:00:01,002' || chr(10) || 'a b c' || chr(10) || chr(10) || '01:00:02,001 --> 01:00:03,002' || chr(10) || 'a b d' AS srt FROM documents"""


@plan(r"""WITH b AS (SELECT doc_id, unnest(range(len(bl))) AS pos, unnest(bl) AS block FROM (SELECT doc_id, string_split_regex(replace(replace(srt, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n\s*\n') AS bl FROM (""" + _SRT + r"""))),
    l AS (SELECT doc_id, pos, list_filter(list_transform(string_split(block, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS lines FROM b),
    t AS (SELECT *, list_position(list_transform(lines, lambda x: contains(x, '-->')), true) AS i FROM l),
    c AS (SELECT doc_id, pos, lines[i] AS t, trim(regexp_replace(regexp_replace(array_to_string(lines[i + 1:], ' '), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS text FROM t WHERE i > 0),
    r AS (SELECT doc_id, pos, text, string_split(translate(rtrim(t[:strpos(t, '-->') - 1]), ',.', '::'), ':') AS a, string_split(translate(split_part(ltrim(t[strpos(t, '-->') + 3:]), ' ', 1), ',.', '::'), ':') AS b FROM c WHERE text <> '' AND contains(t, ' --> ')),
    v AS (SELECT * FROM r WHERE """ + " AND ".join(f"len({x}) = 4 AND len({x}[1]) <= 2 AND len({x}[2]) = 2 AND len({x}[3]) = 2 AND len({x}[4]) <= 3 AND len(list_filter({x}, lambda y: TRY_CAST(y AS INT) IS NULL)) = 0" for x in "ab") + r"""),
    s AS (SELECT doc_id, pos, """ + ", ".join(f"(({x}[1]::INT * 60 + {x}[2]::INT) * 60 + {x}[3]::INT) * 1000 + rpad({x}[4], 3, '0')::INT AS {y}" for x, y in ("as", "be")) + r""", text, lag(text) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM v)
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, s AS start_ms, greatest(s, e) AS end_ms, text FROM s WHERE before IS NULL OR before <> text""")
def x3_parse_srt(spark, sf_dir):
    view(spark, sf_dir, "memories_v")
    return extract.parse_srt(spark.sql(_SRT), "doc_id", "srt")


_TRACKS = "SELECT source AS item_id, doc_id AS pos, upper(lang) AS language, CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE text END AS srt FROM documents"


@plan(rf"""SELECT item_id, language, substr(srt, 1, 250000) AS srt FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY lower(language) <> 'de', pos) AS n FROM ({_TRACKS}) WHERE regexp_replace(srt, '^\s+|\s+$', '', 'g') <> '') WHERE n = 1""")
def x4_pick_subtitle(spark, sf_dir):
    view(spark, sf_dir, "memories_v")
    return extract.pick_subtitle(spark.sql(_TRACKS), "item_id", "de")


@plan(r"""SELECT memory_id, modality, start_ms, end_ms, CAST(NULL AS INTEGER) AS album_index, substr(regexp_replace(content, '^\s+|\s+$', '', 'g'), 1, 20000) AS content
    FROM (SELECT memory_id, modality, start_ms, end_ms, CASE WHEN segment_id % 13 = 0 THEN chr(10) || ' ' ELSE ' ' || content || chr(10) END AS content FROM segments_v WHERE modality IN ('speech', 'ocr')) WHERE regexp_replace(content, '^\s+|\s+$', '', 'g') <> ''""")
def x5_to_segments(spark, sf_dir):
    s = view(spark, sf_dir, "segments_v").withColumn("content", F.expr("CASE WHEN segment_id % 13 = 0 THEN chr(10) || ' ' ELSE ' ' || content || chr(10) END"))
    parts = [extract.to_segments(s.where(F.col("modality") == m), "memory_id", m, "content", "start_ms", "end_ms") for m in ("speech", "ocr")]
    return parts[0].unionByName(parts[1])


def _rfind(sep: str) -> str:
    n = 1 if sep == "chr(10)" else len(sep) - 2
    return f"(CASE WHEN contains(cut, {sep}) THEN length(cut) - position(reverse({sep}) IN reverse(cut)) - {n} + 1 ELSE -1 END)"


_LEAD = "CASE WHEN length(t) <= 400 THEN t " + " ".join(f"WHEN {_rfind(s)} > 200 THEN regexp_replace(substr(cut, 1, CAST({_rfind(s)} + 1 AS BIGINT)), '^\\s+|\\s+$', '', 'g')" for s in ("'. '", "'! '", "'? '", "chr(10)")) + f""" ELSE regexp_replace(CASE WHEN {_rfind("' '")} > 0 THEN substr(cut, 1, CAST({_rfind("' '")} AS BIGINT)) ELSE cut END, '^\\s+|\\s+$', '', 'g') || '…' END"""


@plan(rf"SELECT doc_id, {_LEAD} AS summary FROM (SELECT doc_id, t, substr(t, 1, 400) AS cut FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents))")
def x6_lead_summary(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", T.lead_summary(F.col("text"), 400).alias("summary"))


@plan(r"SELECT doc_id, 'Said: ' || CASE WHEN length(t) > 200 THEN rtrim(substr(t, 1, 200)) || '…' ELSE t END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)")
def x7_snippet(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text"), "Said: ").alias("snippet"))


@plan("""SELECT frame_id, CASE WHEN album_index IS NOT NULL THEN 'Visual match: photo ' || CAST(album_index + 1 AS VARCHAR) ELSE 'Visual match near ' || CAST(ms // 60000 AS VARCHAR) || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') END AS snippet
    FROM (SELECT frame_id, album_index, timestamp_ms * 37 AS ms FROM frames_v)""")
def x8_visual_snippet(spark, sf_dir):
    return view(spark, sf_dir, "frames_v").select("frame_id", T.visual_snippet(F.col("timestamp_ms") * 37, F.col("album_index")).alias("snippet"))


_FRAMES = "SELECT item_id, 'Sure:' || chr(10) || 'Frame 0: ' || replace(text, chr(10), ' ') || chr(10) || ' frame #1 -:  (No text) ' || chr(10) || 'Frame 2:' || chr(10) || 'FRAME 3: N/A' || chr(10) || 'Frame 0: x: ' || cast(item_id AS string) || chr(13) || chr(10) || 'Frame 1' || cast(item_id % 10 AS string) || ': end' AS lines FROM benchmark"


@plan(r"""SELECT item_id, frame * 5000 AS timestamp_ms, text FROM (
    SELECT item_id, frame, arg_max(text, pos) AS text FROM (
        SELECT item_id, pos, TRY_CAST(regexp_replace(regexp_extract(line, '^([^:]*)', 1), '[^0-9]', '', 'g') AS INTEGER) AS frame, trim(regexp_extract(line, '^[^:]*:(.*)$', 1)) AS text FROM (
            SELECT item_id, unnest(range(len(l))) AS pos, trim(unnest(l)) AS line FROM (SELECT item_id, string_split(regexp_replace(lines, '\r\n?', chr(10), 'g'), chr(10)) AS l FROM (""" + _FRAMES + r""")))
        WHERE lower(line) LIKE 'frame%') WHERE frame IS NOT NULL AND text <> '' GROUP BY ALL) WHERE lower(text) NOT IN ('(no text)', 'none', 'n/a')""")
def x9_parse_frame_lines(spark, sf_dir):
    view(spark, sf_dir, "benchmark").createOrReplaceTempView("benchmark")
    return extract.parse_frame_lines(spark.sql(_FRAMES), "item_id", "lines", "visual")


# answers made of conversation turns; every 7th has no braces, every 11th is broken
_ANSWERS = """SELECT conv_id * 1000 + turn AS response_id, CASE WHEN turn % 7 = 3 THEN 'nothing' WHEN (conv_id + turn) % 11 = 0 THEN '{"answer": ' || '}' ELSE 'Here: {"answer": "' || regexp_replace(text, '[^A-Za-z ]', '') || ' ", "evidence_coverage": "' || CASE WHEN turn % 2 = 0 THEN 'FULL' ELSE 'most' END || '", "claims": ["a ", "", "b' || cast(turn AS string) || '"], "citations": [{"modality": "Speech", "timestamp_ms": ' || cast(turn - 1 AS string) || ', "quote": " q"}, {"modality": "smell", "quote": "x"}, {"modality": "ocr", "quote": "  "}]} bye' END AS response FROM conversations WHERE role = 'assistant'"""
_ANSWERS_DUCK = _ANSWERS.replace("'[^A-Za-z ]', '')", "'[^A-Za-z ]', '', 'g')")


@plan(rf"""WITH a AS ({_ANSWERS_DUCK}), b AS (SELECT response_id, response, position('{{' IN response) AS i, length(response) - position('}}' IN reverse(response)) + 1 AS j FROM a),
    c AS (SELECT response_id, CASE WHEN i > 0 AND contains(response, '}}') AND j > i THEN substr(response, i, j - i + 1) END AS body FROM b),
    d AS (SELECT response_id, body, CASE WHEN body IS NULL THEN 'non-JSON' WHEN NOT json_valid(body) THEN 'invalid JSON' WHEN trim(coalesce(json_extract_string(body, '$.answer'), '')) = '' THEN 'empty answer' END AS error FROM c)
    SELECT response_id, error, CASE WHEN error IS NULL THEN trim(json_extract_string(body, '$.answer')) END AS answer,
        CASE WHEN error IS NULL THEN CASE WHEN lower(json_extract_string(body, '$.evidence_coverage')) IN ('full', 'partial', 'none') THEN lower(json_extract_string(body, '$.evidence_coverage')) ELSE 'partial' END END AS evidence_coverage,
        CASE WHEN error IS NULL THEN array_to_string(list_filter(list_transform(CAST(json_extract(body, '$.claims') AS VARCHAR[]), lambda x: trim(x)), lambda x: x <> '')[1:10], '|') END AS claims,
        CASE WHEN error IS NULL THEN array_to_string(list_transform(list_filter(json_transform(json_extract(body, '$.citations'), '[{{"modality": "VARCHAR", "timestamp_ms": "DOUBLE", "quote": "VARCHAR"}}]'), lambda x: lower(x.modality) IN ('speech', 'visual', 'ocr', 'caption', 'article') AND trim(coalesce(x.quote, '')) <> ''),
            lambda x: lower(x.modality) || '@' || coalesce(CASE WHEN x.timestamp_ms >= 0 THEN CAST(CAST(x.timestamp_ms AS INTEGER) AS VARCHAR) END, '') || ':' || trim(x.quote)), '|') END AS citations
    FROM d""")
def x10_parse_answers(spark, sf_dir):
    view(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    out = extract.parse_responses(spark.sql(_ANSWERS), "response_id", "response", "answer")
    cites = F.array_join(F.transform("citations", lambda c: F.concat(c["modality"], F.lit("@"), F.coalesce(c["timestamp_ms"].cast("string"), F.lit("")), F.lit(":"), c["quote"])), "|")
    return out.select("response_id", "error", "answer", "evidence_coverage", F.array_join("claims", "|").alias("claims"), cites.alias("citations"))


_INTENTS = """SELECT conv_id * 1000 + turn AS response_id, '{"domain": " ' || regexp_replace(text, '[^A-Za-z .]', '') || '", "intent": "", "confidence": "' || CASE WHEN turn % 2 = 0 THEN 'HIGH' ELSE 'sure' END || '", "label": "' || CASE WHEN turn % 3 = 0 THEN '' ELSE 'L ' || cast(turn AS string) END || '"}' AS response FROM conversations"""


@plan(rf"""WITH a AS ({_INTENTS.replace("'[^A-Za-z .]', '')", "'[^A-Za-z .]', '', 'g')")}),
    s AS (SELECT response_id, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(trim(json_extract_string(response, '$.domain'))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 40), ''), 'other') AS domain,
        lower(json_extract_string(response, '$.confidence')) AS confidence, json_extract_string(response, '$.label') AS label FROM a)
    SELECT response_id, CAST(NULL AS VARCHAR) AS error, domain, 'explore' AS intent, CASE WHEN confidence IN ('high', 'medium', 'low') THEN confidence ELSE 'low' END AS confidence, CASE WHEN label <> '' THEN label ELSE 'explore / ' || domain END AS label FROM s""")
def x10_parse_intents(spark, sf_dir):
    view(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    return extract.parse_responses(spark.sql(_INTENTS), "response_id", "response", "intent")


# the other four shapes, of the words of every turn; some without braces, some broken, some without what is required
_WORDS = "regexp_replace(text, '[^A-Za-z ]', '')"
_FAULTY = "CASE WHEN turn % 7 = 3 THEN 'nothing' WHEN (conv_id + turn) % 11 = 0 THEN '{\"title\": ' || '}' WHEN (conv_id + turn) % 13 = 0 THEN '{\"note\": 1}'"
_TURN = "cast(turn AS string)"

_ACTIONS = f"""SELECT conv_id * 1000 + turn AS response_id, {_FAULTY} ELSE 'Plan: {{"actions": [{{"title": " ' || {_WORDS} || '", "detail": " d' || {_WORDS} || ' ", "priority": "' || CASE WHEN turn % 2 = 0 THEN 'p0' ELSE 'soon' END || '", "effort": "' || CASE WHEN turn % 3 = 0 THEN 'HIGH' ELSE '' END || '", "evidence": {{"modality": "OCR", "timestamp_ms": ' || cast(turn * 1500 - 2000 AS string) || '.5, "quote": " q' || {_WORDS} || '", "album_index": ' || cast(turn - 2 AS string) || '}}}}, {{"title": "  ", "evidence": {{"modality": "ocr", "quote": "x"}}}}, {{"title": "no evidence"}}, {{"title": "smelt", "evidence": {{"modality": "smell", "quote": "x"}}}}' || repeat(', {{"title": "again", "priority": "P3", "evidence": {{"modality": "speech", "quote": "x"}}}}', cast(turn * 7 AS int)) || ']}} done' END AS response FROM conversations"""
_BRIEFS = f"""SELECT conv_id * 1000 + turn AS response_id, {_FAULTY} ELSE '{{"summary": " ' || {_WORDS} || ' ", "key_claims": ["a ", " "' || repeat(', "more"', cast(turn * 3 AS int)) || '], "usefulness_assessment": "' || CASE WHEN turn % 5 = 1 THEN ' ' ELSE 'worth it' END || '", "effort_estimate": "' || CASE WHEN turn % 2 = 0 THEN 'Low' ELSE 'huge' END || '"' || CASE turn % 4 WHEN 0 THEN ', "open_question": "Why? "' WHEN 1 THEN ', "open_question": " It is so."' ELSE '' END || '}}' END AS response FROM conversations"""
_CARDS = f"""SELECT conv_id * 1000 + turn AS response_id, {_FAULTY} ELSE '{{"title": "' || CASE WHEN turn % 4 = 1 THEN '' ELSE {_WORDS} END || '", "summary": "' || {_WORDS} || '", "category": "' || CASE WHEN turn % 2 = 0 THEN 'Food' ELSE 'cars' END || '", "tags": [" ", "One' || repeat({_WORDS}, 2) || '"' || repeat(', "T"', cast(turn * 2 AS int)) || ']' || CASE WHEN turn % 3 = 0 THEN ', "language": "a language with a long name"' ELSE '' END || '}}' END AS response FROM conversations"""
_FINDINGS = f"""SELECT conv_id * 1000 + turn AS response_id, {_FAULTY} ELSE '{{"findings": [{{"claim": "' || {_WORDS} || '", "verdict": "' || CASE WHEN turn % 2 = 0 THEN 'SUPPORTED' ELSE 'maybe' END || '", "sources": [{{"title": "' || {_WORDS} || '", "url": "https://a/' || {_TURN} || '"}}, {{"title": "f", "url": "ftp://a"}}, {{"url": "http://b"}}, {{"title": "no address"}}]}}, {{"verdict": "contradicted"}}]}}' END AS response FROM conversations"""


def _bodies(texts: str, lacks: str = "") -> str:
    """What lies between the outermost braces of each text, and what is wrong with it."""
    texts = texts.replace("'[^A-Za-z ]', '')", "'[^A-Za-z ]', '', 'g')")
    return f"""WITH a AS ({texts}), b AS (SELECT *, strpos(response, '{{') AS i, length(response) - strpos(reverse(response), '}}') + 1 AS j FROM a),
    c AS (SELECT response_id, CASE WHEN i > 0 AND contains(response, '}}') AND j > i THEN response[i:j] END AS body FROM b),
    d AS (SELECT response_id, body, CASE WHEN body IS NULL THEN 'non-JSON' WHEN NOT json_valid(body) THEN 'invalid JSON' {lacks} END AS error FROM c),
    good AS (SELECT * FROM d WHERE error IS NULL), """


_BLANK = "trim(coalesce(json_extract_string(body, '$.{}'), '')) = ''"


def _choice(value: str, allowed: str, default: str) -> str:
    return f"CASE WHEN {value} IN {allowed} THEN {value} ELSE '{default}' END"


def _parsed(spark, sf_dir, texts: str, kind: str):
    view(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    return extract.parse_responses(spark.sql(texts), "response_id", "response", kind)


def _line(*columns):
    """One text of some fields, null ones as nothing."""
    return F.concat_ws("~", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


@plan(_bodies(_ACTIONS, "WHEN json_extract_string(body, '$.actions') IS NULL THEN 'no actions'") + f"""
    x AS (SELECT response_id, i, json_extract(body, '$.actions[' || i || ']') AS x FROM good, unnest(range(CAST(json_array_length(body, '$.actions') AS BIGINT))) AS u(i)),
    f AS (SELECT response_id, i, trim(coalesce(json_extract_string(x, '$.title'), '')) AS title, trim(coalesce(json_extract_string(x, '$.detail'), '')) AS detail, upper(json_extract_string(x, '$.priority')) AS p, lower(json_extract_string(x, '$.effort')) AS e,
        lower(json_extract_string(x, '$.evidence.modality')) AS m, CAST(json_extract_string(x, '$.evidence.timestamp_ms') AS DOUBLE) AS ts, trim(coalesce(json_extract_string(x, '$.evidence.quote'), '')) AS q, CAST(json_extract_string(x, '$.evidence.album_index') AS INTEGER) AS album FROM x),
    k AS (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY i) AS n FROM f WHERE title <> '' AND q <> '' AND m IN ('speech', 'visual', 'ocr', 'caption', 'article'))
    SELECT d.response_id, d.error, CAST(CASE WHEN d.error IS NULL THEN coalesce(least(g.n, 20), 0) END AS INTEGER) AS n_actions, CASE WHEN d.error IS NULL THEN coalesce(g.l, '') END AS actions FROM (SELECT DISTINCT response_id, error FROM d) d LEFT JOIN (
        SELECT response_id, max(n) AS n, string_agg(concat_ws('~', title[:200], detail[:2000], {_choice("p", "('P0', 'P1', 'P2', 'P3')", "P2")}, {_choice("e", "('low', 'medium', 'high')", "medium")}, m, CASE WHEN ts >= 0 THEN CAST(trunc(ts) AS INTEGER)::VARCHAR ELSE '' END, q[:500], CASE WHEN album >= 0 THEN album::VARCHAR ELSE '' END), '|' ORDER BY n) FILTER (n <= 20) AS l FROM k GROUP BY response_id) g USING (response_id)""")
def x10_parse_actions(spark, sf_dir):
    out = _parsed(spark, sf_dir, _ACTIONS, "actions")
    line = lambda a: _line(a["title"], a["detail"], a["priority"], a["effort"], *[a["evidence"][f] for f in ("modality", "timestamp_ms", "quote", "album_index")])
    return out.select("response_id", "error", F.size("actions").alias("n_actions"), F.array_join(F.transform("actions", line), "|").alias("actions"))


@plan(_bodies(_BRIEFS, f"WHEN {_BLANK.format('summary')} THEN 'empty summary' WHEN {_BLANK.format('usefulness_assessment')} THEN 'no assessment'") + f"""
    q AS (SELECT response_id, body, trim(coalesce(json_extract_string(body, '$.open_question'), '')) AS q, lower(json_extract_string(body, '$.effort_estimate')) AS e FROM good)
    SELECT response_id, error, NULL AS summary, NULL AS key_claims, NULL AS usefulness_assessment, NULL AS effort_estimate, NULL AS open_question FROM d WHERE error IS NOT NULL UNION ALL
    SELECT response_id, NULL, trim(json_extract_string(body, '$.summary')), array_to_string(list_filter(list_transform(CAST(json_extract(body, '$.key_claims') AS VARCHAR[]), lambda x: trim(x)), lambda x: x <> '')[1:10], '|'), trim(json_extract_string(body, '$.usefulness_assessment')),
        {_choice("e", "('low', 'medium', 'high')", "medium")}, CASE WHEN q LIKE '%?' THEN q ELSE trim(q || ' Do you want to do this?') END FROM q""")
def x10_parse_briefs(spark, sf_dir):
    return _parsed(spark, sf_dir, _BRIEFS, "brief").withColumn("key_claims", F.array_join("key_claims", "|"))


@plan(_bodies(_CARDS) + f"""
    c2 AS (SELECT *, lower(json_extract_string(body, '$.category')) AS c FROM good)
    SELECT response_id, error, NULL AS title, NULL AS summary, NULL AS category, NULL AS tags, NULL AS language FROM d WHERE error IS NOT NULL UNION ALL
    SELECT response_id, NULL, coalesce(nullif(json_extract_string(body, '$.title'), ''), 'Untitled reel')[:120], coalesce(json_extract_string(body, '$.summary'), '')[:4000], {_choice("c", str(extract.CATEGORIES), "other")},
        coalesce(array_to_string(list_transform(list_filter(CAST(json_extract(body, '$.tags') AS VARCHAR[]), lambda x: trim(x) <> '')[1:8], lambda x: lower(x)[1:64]), '|'), ''), nullif(json_extract_string(body, '$.language'), '')[:16] FROM c2""")
def x10_parse_cards(spark, sf_dir):
    return _parsed(spark, sf_dir, _CARDS, "card").withColumn("tags", F.array_join("tags", "|"))


@plan(_bodies(_FINDINGS) + f"""
    x AS (SELECT response_id, body, list_transform(json_transform(json_extract(body, '$.findings'), '[{{"claim": "VARCHAR", "verdict": "VARCHAR", "sources": [{{"title": "VARCHAR", "url": "VARCHAR"}}]}}]'), lambda f:
        concat_ws('~', coalesce(f.claim, '')[1:500], {_choice("lower(f.verdict)", "('supported', 'contradicted', 'uncertain')", "uncertain")}, coalesce(array_to_string(list_transform(list_filter(f.sources, lambda s: starts_with(s.url, 'http://') OR starts_with(s.url, 'https://')), lambda s: coalesce(s.title, '')[1:200] || '@' || s.url), ' '), ''))) AS l FROM good)
    SELECT response_id, error, CAST(NULL AS INTEGER) AS n_findings, NULL AS findings FROM d WHERE error IS NOT NULL UNION ALL SELECT response_id, NULL, CAST(coalesce(len(l), 0) AS INTEGER), coalesce(array_to_string(l, '|'), '') FROM x""")
def x10_parse_findings(spark, sf_dir):
    out = _parsed(spark, sf_dir, _FINDINGS, "findings")
    line = lambda f: _line(f["claim"], f["verdict"], F.array_join(F.transform(f["sources"], lambda s: F.concat(s["title"], F.lit("@"), s["url"])), " "))
    return out.select("response_id", "error", F.size("findings").alias("n_findings"), F.array_join(F.transform("findings", line), "|").alias("findings"))


@plan("""SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'category') AS category_slug,
    coalesce(nullif(substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 40), ''), 'other') AS intent_slug FROM documents""")
def x11_slugs(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", T.slug(F.col("text")).alias("category_slug"), T.slug(F.col("text"), "_", "other", 40).alias("intent_slug"))


_SPEECH = """SELECT item_id, CASE WHEN item_id % 4 = 0 THEN '{"segments": [], "text": " whole ' || cast(item_id AS string) || '"}' ELSE '{"segments": [{"start": ' || cast(item_id AS string) || '.5, "end": ' || cast(item_id + 1 AS string) || '.25, "text": " hi"}, {"start": 9, "text": "  "}, {"text": "no time"}]}' END AS response FROM benchmark"""


@plan(rf"""WITH r AS ({_SPEECH}), j AS (SELECT item_id, response, json_transform(json_extract(response, '$.segments'), '[{{"start": "DOUBLE", "end": "DOUBLE", "text": "VARCHAR"}}]') AS s FROM r),
    k AS (SELECT item_id, CASE WHEN len(s) > 0 THEN s ELSE [{{'start': 0.0::DOUBLE, 'end': 0.0::DOUBLE, 'text': json_extract_string(response, '$.text')}}] END AS s FROM j)
    SELECT item_id, CAST(pos AS INTEGER) AS pos, CAST(trunc(coalesce(x.start, 0) * 1000) AS INTEGER) AS start_ms, CAST(trunc(coalesce(x."end", 0) * 1000) AS INTEGER) AS end_ms, trim(x.text) AS text FROM (SELECT item_id, unnest(range(len(s))) AS pos, unnest(s) AS x FROM k) WHERE trim(x.text) <> ''""")
def x12_transcript_segments(spark, sf_dir):
    view(spark, sf_dir, "benchmark").createOrReplaceTempView("benchmark")
    return extract.transcript_segments(spark.sql(_SPEECH), "item_id", "response")
