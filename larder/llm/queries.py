"""The registered queries of the ten operators, over their whole tables, and their SQL."""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import licenses, media, negatives, packing, pieces, pii, runs, shards, simhash, toxicity, urls, vectors, warc
from larder.session import shared_folder, spread, table

ARRIVALS = 4  # appends that the documents come in, all of them together


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op2_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(spread(table(spark, sf_dir, "documents")))


def op4_distinct_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("piece_bpe_32k.model"))


def op5_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_bundles(warc.write_bundles(spread(table(spark, sf_dir, "pages"))))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(spread(table(spark, sf_dir, "documents")))


def op7_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.texts_as_media(spread(table(spark, sf_dir, "documents"))).drop("declared_type", "actual_type")


def op8_simhash_gph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(spread(table(spark, sf_dir, "documents")))


def op9_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in parts, are compacted until nothing is due, and are read through the newest manifest."""
    store = shards.ShardStore(spark, f"{shared_folder(spark)}/larder-shards-{uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for k in range(ARRIVALS):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == k))
    version = store.version()
    while (newer := store.compact()) != version:
        version = newer
    sizes = store.manifest(version).select("shard", F.col("bytes").alias("shard_bytes"), F.col("level").alias("shard_level"))
    rows = store.read(version, schema=docs.schema).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.col("__shard").alias("shard"))
    return rows.join(sizes, "shard").select("doc_id", "n_chars", "shard", "shard_bytes", "shard_level", F.lit(version).cast("long").alias("version"))


def op10_toxicity_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op11_path_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), URL_RULES)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the documents, of which one in ten ends in a planted repetition; digests of what the operator found."""
    h = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(1))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    sized = docs.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumns({"n": n, "g": g}).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    sized = sized.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = lambda w, i: F.when(i >= F.col("a"), F.get(F.col("words"), (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))).otherwise(w)
    planted = sized.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.transform("words", tail), " ")).otherwise(F.col("text")).alias("text"))
    found = runs.periodic_runs(spread(planted))
    # the greatest exact length / period; equal ones by start, then period, the order that the runs have
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    exact = F.expr("(1000 * best.length) div best.period")
    return found.withColumn("best", best).select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", exact.alias("exponent_milli"), F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_secondary_sort_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("bigint")
    return negatives.mine_hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, new_label=F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


QUERIES = {
    f.__name__: f
    for f in (op1_hilbert_packing, op2_collision_counting, op3_boosted_pii, op4_distinct_chunks, op5_seekable_warc, op6_license_compression, op7_signature_sniffing, op8_simhash_gph, op9_tiered_compaction, op10_toxicity_machine,
              op11_path_template_tree, op12_periodic_runs, op13_secondary_sort_negatives)
}

_BY_LENGTH = sorted(URL_RULES, key=lambda r: -len(r[1]))
_FITS = [(what, rule, f"(host = '{rule.split('/')[0]}' OR ends_with(host, '.{rule.split('/')[0]}')) AND starts_with(path, '{rule[rule.index('/'):]}')") for what, rule in _BY_LENGTH]
_RULE = " ".join(f"WHEN {fits} THEN '{rule}'" for _, rule, fits in _FITS)
_SAID = " ".join(f"WHEN {fits} THEN '{what}'" for what, _, fits in _FITS)


def _tree_level(k: int) -> str:
    """One level of the tree, from the root down."""
    return f"""
        of_{k} AS (SELECT host, parts, segs[{k}] AS s, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY host, parts) AS total FROM tree_{k - 1} GROUP BY host, parts, segs[{k}]),
        tree_{k} AS (SELECT t.host, t.shape, t.n, t.segs, CASE WHEN t.segs[{k}] IS NULL THEN t.parts WHEN contains(t.segs[{k}], '{{') OR t.segs[{k}] = '' OR (o.n >= {urls.LEAST} AND o.n >= {urls.SHARE} * o.total) THEN t.parts || [t.segs[{k}]] ELSE t.parts || ['*'] END AS parts
            FROM tree_{k - 1} t LEFT JOIN of_{k} o ON o.host = t.host AND o.parts = t.parts AND o.s = t.segs[{k}])"""


def _merge_level(k: int, now: str) -> str:
    """One level of the comparison of siblings: now_k from `now`."""
    return f"""
        cut_{k} AS (SELECT *, template[{k}] AS b, template[:{k - 1}] AS pre, template[{k + 1}:] AS suf FROM {now}),
        flat_{k} AS (SELECT host, pre, b, suf, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked FROM cut_{k} WHERE b IS NOT NULL AND NOT contains(b, '{{') AND NOT contains(b, '*') GROUP BY ALL),
        form_{k} AS (SELECT *, first_value(suf) OVER (PARTITION BY host, pre, b ORDER BY n DESC, suf DESC) AS form FROM flat_{k}),
        formed_{k} AS (SELECT *, sum(n) OVER o AS branch_n, sum(labelled) OVER o AS bl, sum(blocked) OVER o AS bb, sum(labelled) OVER f AS fl, sum(blocked) OVER f AS fb FROM form_{k} WINDOW o AS (PARTITION BY host, pre, b), f AS (PARTITION BY host, pre, form)),
        sided_{k} AS (SELECT *, CASE WHEN bl > 0 THEN 2 * bb > bl ELSE 2 * fb > fl END AS side FROM formed_{k}),
        counted_{k} AS (SELECT *, sum(n) OVER s AS all_n, sum(labelled) OVER s AS al, sum(blocked) OVER s AS ab, sum(n) OVER (PARTITION BY host, pre, form, side, suf) AS suf_n FROM sided_{k} WINDOW s AS (PARTITION BY host, pre, form, side)),
        kinds_{k} AS (SELECT host, pre, form, side, greatest(count(DISTINCT suf) - 1, 1) AS free FROM sided_{k} GROUP BY ALL),
        one_{k} AS (SELECT host, pre, b, form, side, sum(n * n / (CAST(branch_n AS DOUBLE) * suf_n / all_n)) AS fit, any_value(branch_n) AS bn, any_value(bl) AS bl, any_value(bb) AS bb, CASE WHEN any_value(al) > 0 THEN CAST(any_value(ab) AS DOUBLE) / any_value(al) ELSE 0 END AS r FROM counted_{k} GROUP BY host, pre, b, form, side),
        alike_{k} AS (SELECT o.* FROM one_{k} o JOIN kinds_{k} USING (host, pre, form, side) WHERE fit - bn <= free + {urls.SIGMAS} * sqrt(2.0 * free) AND abs(bb - bl * r) <= {urls.SIGMAS} * sqrt(bl * r * (1 - r)) + 0.5),
        names_{k} AS (SELECT host, pre, form, side, list(b ORDER BY b) AS names FROM alike_{k} GROUP BY ALL HAVING count(*) > 1),
        now_{k} AS (SELECT c.host, c.parts, c.n, c.labelled, c.blocked, CASE WHEN names IS NULL THEN template ELSE c.pre || ['{{' || array_to_string(names, '|') || '}}'] || c.suf END AS template
            FROM cut_{k} c LEFT JOIN (SELECT host, pre, b, names FROM alike_{k} JOIN names_{k} USING (host, pre, form, side)) a ON a.host = c.host AND a.pre = c.pre AND a.b = c.b)"""


ORACLE_SQL: dict[str, str] = {
    "op11_path_template_tree": f"""
        WITH behind AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS u FROM pages),
        split AS (SELECT page_id, translate(regexp_extract(u, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host, regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path FROM behind),
        known AS (SELECT *, CASE {_RULE} END AS rule, CASE {_SAID} END AS said, regexp_replace(regexp_replace(path, '[0-9A-Fa-f]{{8,}}(-[0-9A-Fa-f]+)*', '{{x}}', 'g'), '[0-9]+', '{{n}}', 'g') AS shape FROM split),
        counted AS (SELECT host, shape, count(*) AS n, count(said) AS labelled, count(*) FILTER (WHERE said = 'block') AS blocked FROM known WHERE host <> '' GROUP BY ALL),
        whole AS (SELECT coalesce(CAST(sum(blocked) AS DOUBLE) / nullif(sum(labelled), 0), 0) AS rate FROM counted),
        tree_0 AS (SELECT host, shape, n, string_split(substr(shape, 2), '/') AS segs, CAST([] AS VARCHAR[]) AS parts FROM counted),
        {",".join(map(_tree_level, range(1, urls.DEPTH + 1)))},
        first AS (SELECT host, shape, parts || CASE WHEN len(segs) > {urls.DEPTH} THEN ['**'] ELSE [] END AS parts FROM tree_{urls.DEPTH}),
        now_{urls.DEPTH + 1} AS (SELECT host, parts, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked, parts AS template FROM first JOIN counted USING (host, shape) GROUP BY host, parts),
        {",".join(_merge_level(k, f"now_{k + 1}") for k in range(urls.DEPTH, 0, -1))},
        pure AS (SELECT host, template, sum(n) AS n, sum(labelled) AS l, round((sum(blocked) + {urls.PRIOR} * any_value(rate)) / (sum(labelled) + {urls.PRIOR}), 6) AS purity FROM now_1, whole GROUP BY host, template),
        told AS (SELECT f.host, f.shape, '/' || array_to_string(p.template, '/') AS template, purity, purity >= {urls.PURITY} AND p.l >= {urls.LEAST} AND p.l >= {urls.COVERAGE} * p.n AS rejected
            FROM first f JOIN now_1 m ON m.host = f.host AND m.parts = f.parts JOIN pure p ON p.host = m.host AND p.template = m.template)
        SELECT page_id, host, path, rule, coalesce(said, CASE WHEN rejected THEN 'block' END, 'allow') AS verdict, template, purity FROM known LEFT JOIN told USING (host, shape)""",
    "op13_secondary_sort_negatives": """
        WITH part AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM part a JOIN part b ON a.id <> b.id WHERE a.id % 100 = 0),
        positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
        near AS (SELECT p.*, n.id AS negative_id, n.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.id) AS rank
            FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same WHERE 80 * positive_score <= 100 * n.score AND n.score <= positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM near WHERE rank <= 5""",
    "op2_collision_counting": """
        WITH RECURSIVE usable AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
        FROM embeddings e JOIN least c ON c.a = e.vec_id LEFT JOIN degrees d ON d.a = e.vec_id""",
    "op5_seekable_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        q AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS hex FROM p),
        best AS (SELECT hex, max(page_id) AS best FROM q GROUP BY hex)
        SELECT q.page_id, CAST(q.n AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(range(32), lambda i:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(5), lambda k:
                    (CAST(1 AS BIGINT) << CAST(4 - k AS BIGINT)) * CAST(substr(bits, CAST(5 * i + k + 1 AS BIGINT), 1) AS BIGINT))) AS BIGINT), 1)), '') AS payload_digest,
            CASE WHEN q.page_id = best.best THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN q.page_id = best.best THEN NULL ELSE best.best END AS refers_to
        FROM (SELECT *, array_to_string(list_transform(range(40), lambda i: lpad(bin(CAST('0x' || substr(hex, CAST(i + 1 AS BIGINT), 1) AS INTEGER)), 4, '0')), '') AS bits FROM q) q
        JOIN best ON best.hex = q.hex""",
}
