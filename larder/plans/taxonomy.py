"""T1-T11 over documents: rules on words that the texts have, so that scores differ."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import taxonomy
from larder.operators.taxonomy import Rule
from larder.plans.base import Plans, view

plan = Plans()

RULES = (
    Rule(("Language", "English"), ("of the", "and the"), ("the", "with", "that", "is", "from the"), 6.0),
    Rule(("Language", "German", "Prose"), ("der die", "in der"), ("und", "der", "die", "ein"), 6.0),
    Rule(("Language", "French", "Prose"), ("de la", "que les"), ("les", "des", "est", "pas"), 6.0),
    Rule(("Culture", "Spanish"), ("de los",), ("los", "las", "una", "por"), 6.0),
    Rule(("Topic", "Law", "Licenses"), ("mit license", "apache license"), ("licensed", "license"), 3.0),
    Rule(("Topic", "Noise"), (), ("idiot", "trash", "clown"), 1.0),
    Rule(("Language",), (), ("a", "le", "el"), 0.5, True),
    Rule(("Culture",), (), ("la", "to"), 0.5, True),
)

_FIELDS = r"""norms AS (SELECT memory_id, segment_id, modality, trim(regexp_replace(lower(content), '[^a-z0-9+.#''_-]+', ' ', 'g')) AS c FROM segments_v),
    spoken AS (SELECT memory_id, modality AS field, trim(regexp_replace(string_agg(c, ' ' ORDER BY segment_id), '[^a-z0-9+.#''_-]+', ' ', 'g')) AS text FROM norms GROUP BY ALL),
    mem AS (SELECT memory_id, title, CASE WHEN memory_id % 2 = 0 THEN 'Caption of The ' || title END AS caption, user_id AS creator FROM memories_v),
    base AS (SELECT memory_id, 'title' AS field, title AS text FROM mem UNION ALL SELECT memory_id, 'caption', caption FROM mem UNION ALL SELECT memory_id, 'creator', creator FROM mem
        UNION ALL SELECT memory_id, 'tags', string_agg(tag, ' ' ORDER BY tag) FROM (SELECT DISTINCT memory_id, tag FROM tags_v) GROUP BY memory_id),
    fields AS (SELECT * FROM (SELECT b.memory_id, b.field, trim(regexp_replace(lower(coalesce(b.text, '')), '[^a-z0-9+.#''_-]+', ' ', 'g')) AS text FROM base b WHERE NOT EXISTS (SELECT 1 FROM spoken s WHERE s.memory_id = b.memory_id AND s.field = b.field) UNION ALL SELECT * FROM spoken) WHERE text <> '')"""
_LISTED = [(i, k, t) for i, r in enumerate(RULES) for k, t in [("strong", t) for t in r.strong] + [("phrase" if " " in t else "keyword", t) for t in r.keywords]]
_TERMS = ", ".join(f"({i}, '{k}', {taxonomy.FACTORS[k]}, '{t}')" for i, k, t in _LISTED)
_WEIGHTS = " ".join(f"WHEN '{f}' THEN {w}" for f, w in taxonomy.FIELD_WEIGHTS.items())
_ABOUT = ", ".join(f"({i}, '{'/'.join(r.path)}', '{r.path[0]}', {len(r.path)}, {r.min_score}, {r.fallback})" for i, r in enumerate(RULES))
_SCORES = f"""{_FIELDS}, terms AS (SELECT * FROM (VALUES {_TERMS}) v(rule, kind, factor, term)),
    about AS (SELECT * FROM (VALUES {_ABOUT}) v(rule, path, root, depth, min_score, fallback)),
    toks AS (SELECT *, list_distinct(regexp_extract_all(text, '[a-z0-9][a-z0-9+.#''_-]*')) AS words, CAST(CASE field {_WEIGHTS} ELSE 1 END AS DOUBLE) AS weight FROM fields),
    scores AS (SELECT memory_id, rule, round(sum(weight * CAST(factor AS DOUBLE)) + max(greatest(0, depth - 2)) * CAST(0.4 AS DOUBLE), 3) AS score FROM toks JOIN terms ON CASE WHEN kind = 'keyword' THEN list_contains(words, term) ELSE contains(text, term) END JOIN about USING (rule) GROUP BY memory_id, rule),
    good AS (SELECT *, bool_or(NOT fallback) OVER (PARTITION BY memory_id) AS hasreal FROM scores JOIN about USING (rule) WHERE score >= min_score),
    ranked AS (SELECT *, row_number() OVER w AS n, coalesce(lead(score) OVER w, 0) AS nxt, first_value(score) OVER w AS best, first_value(root) OVER w AS best_root FROM good WHERE fallback <> hasreal WINDOW w AS (PARTITION BY memory_id ORDER BY score DESC, depth DESC, rule)),
    decided AS (SELECT m.memory_id, m.creator AS user_id, coalesce(r.path, 'Other/Uncategorized') AS path, coalesce(score, 0.0) AS score,
        coalesce(CASE WHEN r.path IS NOT NULL THEN round(least(0.98, 0.58 + least(score, 35.0) / 100 + least(greatest(0.0, score - nxt), 20.0) / 80), 3) END, CASE WHEN EXISTS (SELECT 1 FROM fields f WHERE f.memory_id = m.memory_id) THEN 0.35 ELSE 0.20 END) AS confidence
        FROM mem m LEFT JOIN (SELECT * FROM ranked WHERE n = 1) r USING (memory_id)),
    second AS (SELECT memory_id, path, round(greatest(0.40, confidence - 0.12), 3) AS confidence FROM (SELECT r.memory_id, r.path, d.confidence, row_number() OVER (PARTITION BY r.memory_id ORDER BY r.n) AS k FROM ranked r JOIN decided d USING (memory_id) WHERE r.n > 1 AND r.root <> best_root AND r.score >= greatest(min_score, best * 0.58)) WHERE k <= 2)"""
# assignments: the decisions, every ninth by hand
_ASSIGNED = f"""{_SCORES}, assigned AS (SELECT user_id, memory_id, path, true AS is_primary FROM decided UNION ALL SELECT d.user_id, s.memory_id, s.path, false FROM second s JOIN decided d USING (memory_id))"""


def _parts(spark, sf_dir):
    m = view(spark, sf_dir, "memories_v").select("memory_id", "user_id", "title")
    items = m.select("memory_id", F.when(F.col("memory_id") % 2 == 0, F.concat(F.lit("Caption of The "), "title")).alias("caption"), F.col("user_id").alias("creator"))
    return m, items, view(spark, sf_dir, "tags_v"), view(spark, sf_dir, "segments_v")


def _scored(spark, sf_dir):
    m, items, tags, s = _parts(spark, sf_dir)
    return m, taxonomy.rule_scores(taxonomy.taxonomy_fields(m, items, tags, s), RULES, unmatched=True)


def _decided(spark, sf_dir):
    m, scores = _scored(spark, sf_dir)
    return taxonomy.classify(m, None, scores, RULES).join(m.select("memory_id", "user_id"), "memory_id")


def _assigned(spark, sf_dir):
    m, scores = _scored(spark, sf_dir)
    d = taxonomy.classify(m, None, scores, RULES)
    both = d.select("memory_id", "path", F.lit(True).alias("is_primary")).unionByName(taxonomy.secondary_paths(scores, d, RULES).select("memory_id", "path", F.lit(False).alias("is_primary")))
    return both.join(m.select("memory_id", "user_id"), "memory_id")


@plan(f"WITH {_FIELDS} SELECT * FROM fields")
def t1_taxonomy_fields(spark, sf_dir):
    return taxonomy.taxonomy_fields(*_parts(spark, sf_dir))


@plan(f"WITH {_SCORES} SELECT memory_id, rule, score FROM scores")
def t2_rule_scores(spark, sf_dir):
    return _scored(spark, sf_dir)[1].where("rule IS NOT NULL")


@plan(f"WITH {_SCORES} SELECT memory_id, path, score, confidence FROM decided")
def t3_classify(spark, sf_dir):
    return _decided(spark, sf_dir).drop("user_id")


@plan(f"WITH {_SCORES} SELECT * FROM second")
def t4_secondary_paths(spark, sf_dir):
    m, scores = _scored(spark, sf_dir)
    return taxonomy.secondary_paths(scores, taxonomy.classify(m, None, scores, RULES), RULES)


@plan(f"""WITH {_ASSIGNED}, n AS (SELECT DISTINCT user_id, array_to_string(string_split(path, '/')[1:k], '/') AS path FROM (SELECT user_id, path, unnest(range(1, len(string_split(path, '/')) + 1)) AS k FROM assigned))
    SELECT user_id, path, string_split(path, '/')[-1] AS name, CAST(len(string_split(path, '/')) - 1 AS INTEGER) AS depth, nullif(array_to_string(string_split(path, '/')[1:-2], '/'), '') AS parent_path FROM n""")
def t5_category_nodes(spark, sf_dir):
    return taxonomy.category_nodes(_assigned(spark, sf_dir))


_EXISTING = "SELECT memory_id, CASE WHEN memory_id % 2 = 0 THEN 'Old/Path' ELSE 'Language/English' END AS path, true AS is_primary, 0.5 AS confidence, CASE WHEN memory_id % 9 = 0 THEN 'manual' ELSE 'rules-v1' END AS source FROM memories_v"


@plan(f"""WITH {_SCORES}, e AS ({_EXISTING}), man AS (SELECT memory_id FROM e WHERE source = 'manual')
    SELECT * FROM e WHERE memory_id IN (SELECT memory_id FROM man) UNION ALL SELECT memory_id, path, true, confidence, 'rules-v1' FROM decided WHERE memory_id NOT IN (SELECT memory_id FROM man)""")
def t6_merge_assignments(spark, sf_dir):
    view(spark, sf_dir, "memories_v").createOrReplaceTempView("memories_v")
    existing = spark.sql(_EXISTING).withColumn("confidence", F.col("confidence").cast("double"))
    desired = _decided(spark, sf_dir).select("memory_id", "path", F.lit(True).alias("is_primary"), "confidence", F.lit("rules-v1").alias("source"))
    return taxonomy.merge_assignments(existing, desired)


@plan(f"WITH {_SCORES} SELECT replace(path, '/', ' > ') AS path, count(*) AS n FROM decided GROUP BY 1")
def t7_reclassify_counts(spark, sf_dir):
    return taxonomy.reclassify_counts(_decided(spark, sf_dir))


@plan(f"""WITH {_ASSIGNED}, u AS (SELECT user_id, path, array_to_string(string_split(path, '/')[1:k], '/') AS node FROM (SELECT *, unnest(range(1, len(string_split(path, '/')) + 1)) AS k FROM assigned WHERE is_primary))
    SELECT user_id, node AS path, CAST(len(string_split(node, '/')) - 1 AS INTEGER) AS depth, count(*) FILTER (WHERE node = path) AS direct, count(*) AS total FROM u GROUP BY user_id, node""")
def t8_category_tree(spark, sf_dir):
    return taxonomy.category_tree(_assigned(spark, sf_dir))


@plan(f"WITH {_ASSIGNED} SELECT memory_id, list(replace(path, '/', ' > ') ORDER BY NOT is_primary, replace(path, '/', ' > ')) AS categories FROM assigned GROUP BY memory_id")
def t9_category_paths(spark, sf_dir):
    return taxonomy.category_paths(_assigned(spark, sf_dir))


@plan(f"WITH {_ASSIGNED} SELECT memory_id, creator AS user_id, title FROM mem WHERE memory_id IN (SELECT memory_id FROM assigned WHERE is_primary AND (path = 'Language' OR path LIKE 'Language/%'))")
def t10_in_subtree(spark, sf_dir):
    return taxonomy.in_subtree(_parts(spark, sf_dir)[0], _assigned(spark, sf_dir), "Language")


@plan(f"""WITH {_SCORES}, truth AS (SELECT memory_id, CASE any_value(lang ORDER BY doc_id) WHEN 'en' THEN 'Language/English' WHEN 'de' THEN 'Language/German/Prose' WHEN 'fr' THEN 'Language/French/Prose' ELSE 'Culture/Spanish' END AS expected_path FROM (SELECT doc_id // 5 AS memory_id, doc_id, lang FROM documents) GROUP BY memory_id)
    SELECT expected_path, path, count(*) AS n, count(*) FILTER (WHERE path = expected_path) AS correct FROM truth LEFT JOIN decided USING (memory_id) GROUP BY ALL""")
def t11_classifier_eval(spark, sf_dir):
    lang = view(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 5).alias("memory_id")).agg(F.min_by("lang", "doc_id").alias("lang"))
    truth = lang.select("memory_id", F.expr("CASE lang WHEN 'en' THEN 'Language/English' WHEN 'de' THEN 'Language/German/Prose' WHEN 'fr' THEN 'Language/French/Prose' ELSE 'Culture/Spanish' END").alias("expected_path"))
    return taxonomy.classifier_eval(_decided(spark, sf_dir), truth)


# A rule table from data: three rules of each benchmark item, which share out its longer words and its pairs of neighbours.
_NORM = r"trim(regexp_replace(lower({}), '[^a-z0-9+.#''_-]+', ' ', 'g'))"
_TABLE = f"""{_FIELDS}, items AS (SELECT item_id, string_split(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')), ' ') AS w FROM benchmark),
    placed AS (SELECT item_id, i, CAST(item_id * 3 + i % 3 AS INTEGER) AS rule, w[i] AS word, w[i] || ' ' || w[i + 1] AS pair, i < len(w) AS paired FROM items, unnest(range(1, len(w) + 1)) AS u(i)),
    about AS (SELECT DISTINCT rule, 'Bench/Part ' || (rule % 3) || '/Item ' || item_id AS path, 'Bench' AS root, 3 AS depth, CASE WHEN item_id % 10 = 0 THEN 0.5 ELSE 20.0 END AS min_score, item_id % 10 = 0 AS fallback FROM placed),
    terms AS (SELECT rule, 'strong' AS kind, {_NORM.format("pair")} AS term FROM placed WHERE paired UNION ALL SELECT rule, CASE WHEN contains({_NORM.format("word")}, ' ') THEN 'phrase' ELSE 'keyword' END, {_NORM.format("word")} FROM placed WHERE length(word) >= 7),
    toks AS (SELECT *, CAST(CASE field {_WEIGHTS} ELSE 1 END AS DOUBLE) AS weight FROM fields),
    singles AS (SELECT DISTINCT memory_id, field, weight, unnest(regexp_extract_all(text, '[a-z0-9][a-z0-9+.#''_-]*')) AS term FROM toks),
    long_terms AS (SELECT DISTINCT term FROM terms WHERE kind <> 'keyword' AND term <> ''),
    holds AS (SELECT memory_id, field, weight, term FROM toks JOIN long_terms ON contains(text, term)),
    hits AS (SELECT memory_id, rule, weight * CAST(0.7 AS DOUBLE) AS s FROM singles JOIN terms USING (term) WHERE kind = 'keyword'
        UNION ALL SELECT memory_id, rule, weight * CASE kind WHEN 'strong' THEN CAST(2.0 AS DOUBLE) ELSE CAST(1.1 AS DOUBLE) END FROM holds JOIN terms USING (term) WHERE kind <> 'keyword'),
    scores AS (SELECT memory_id, rule, round(sum(s) + CAST(0.4 AS DOUBLE), 3) AS score FROM hits GROUP BY ALL)"""


def bench_rules(spark, sf_dir):
    """Some 600 rules with some 9,000 terms."""
    w = F.split(F.trim(F.regexp_replace("text", "[ \t\n\r]+", " ")), " ")
    rows = view(spark, sf_dir, "benchmark").select("item_id", w.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    at = lambda last: F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: (i % 3 == F.col("k")) & (i <= F.size("w") - last))
    words = F.filter(F.transform(at(0), lambda i: F.get("w", i - 1)), lambda t: F.length(t) >= 7)
    pairs = F.transform(at(1), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))
    fallback = F.col("item_id") % 10 == 0
    path = F.array(F.lit("Bench"), F.concat(F.lit("Part "), "k"), F.concat(F.lit("Item "), "item_id"))
    return rows.select((F.col("item_id") * 3 + F.col("k")).cast("int").alias("rule"), path.alias("path"), pairs.alias("strong"), words.alias("keywords"), F.when(fallback, 0.5).otherwise(20.0).alias("min_score"), fallback.alias("fallback"))


def _by_table(spark, sf_dir):
    m, items, tags, s = _parts(spark, sf_dir)
    rules = bench_rules(spark, sf_dir)
    return m, taxonomy.rule_scores(taxonomy.taxonomy_fields(m, items, tags, s), rules, unmatched=True), rules


@plan(f"WITH {_TABLE} SELECT memory_id, rule, score FROM scores")
def t2_rule_table(spark, sf_dir):
    return _by_table(spark, sf_dir)[1].where("rule IS NOT NULL")


@plan(f"""WITH {_TABLE}, good AS (SELECT *, bool_or(NOT fallback) OVER (PARTITION BY memory_id) AS hasreal FROM scores JOIN about USING (rule) WHERE score >= min_score),
    ranked AS (SELECT *, row_number() OVER w AS n, coalesce(lead(score) OVER w, 0) AS nxt FROM good WHERE fallback <> hasreal WINDOW w AS (PARTITION BY memory_id ORDER BY score DESC, depth DESC, rule))
    SELECT m.memory_id, coalesce(path, 'Other/Uncategorized') AS path, coalesce(score, 0.0) AS score,
        coalesce(CASE WHEN path IS NOT NULL THEN CAST(round(CAST(CAST(least(0.98, 0.58 + least(score, 35.0) / 100 + least(greatest(0.0, score - nxt), 20.0) / 80) AS VARCHAR) AS DECIMAL(38, 20)), 3) AS DOUBLE) END, CASE WHEN EXISTS (SELECT 1 FROM fields f WHERE f.memory_id = m.memory_id) THEN 0.35 ELSE 0.20 END) AS confidence
    FROM mem m LEFT JOIN (SELECT * FROM ranked WHERE n = 1) r USING (memory_id)""")
def t3_rule_table(spark, sf_dir):
    m, scores, rules = _by_table(spark, sf_dir)
    return taxonomy.classify(m, None, scores, rules)
