"""Rule classification and the category tree.

Rules are data: a tuple of `Rule`, or a table of any size with the same columns (`RULES_SCHEMA`; `rule` orders ties).
Their terms become one automaton for phrases and one dictionary for words, in blocks of at most TERM_BYTES, so a text is
read once for each block whatever the number of rules, and no text meets a term that it does not hold.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

# How much a field counts, and what a kind of term counts.
FIELD_WEIGHTS = {"title": 6.0, "caption": 4.0, "creator": 2.0, "tags": 3.0, "ocr": 2.3, "speech": 1.5, "article": 2.0, "summary": 1.0, "visual": 1.8}
FACTORS = {"strong": 2.0, "phrase": 1.1, "keyword": 0.7}
TERM_BYTES = 8 << 20  # of terms that one automaton holds: what a task keeps, and what the driver sends at once
SLICE = 256  # texts that a task turns into Python objects at once
RULES_SCHEMA = "rule int, path array<string>, strong array<string>, keywords array<string>, min_score double, fallback boolean"


@dataclass(frozen=True)
class Rule:
    path: tuple[str, ...]
    strong: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    min_score: float = 3.0
    fallback: bool = False


#: A small rule set of our own, to start from.
EXAMPLE_RULES = (
    Rule(("Technology", "AI", "Coding Agents"), ("coding agent", "pair programming with ai"), ("agent", "copilot", "prompt", "codebase")),
    Rule(("Technology", "AI", "Writing"), ("writing assistant",), ("draft", "rewrite", "tone")),
    Rule(("Learning", "Drills"), ("practice drill", "spaced repetition"), ("flashcards", "exercise", "lesson")),
    Rule(("Sport", "Motor Racing"), ("race weekend", "grand prix"), ("lap", "pit", "qualifying")),
    Rule(("Sport", "Football"), ("penalty kick", "champions league"), ("goal", "striker", "offside")),
    Rule(("Home", "Security", "Cameras"), ("security camera", "cctv"), ("surveillance", "doorbell")),
    Rule(("Going Out", "Bars"), ("cocktail bar", "rooftop bar"), ("bar", "cocktail", "drinks")),
    Rule(("Business", "Models"), ("business model", "unit economics"), ("startup", "margin", "saas")),
    Rule(("Home", "Property"), ("real estate", "floor plan"), ("apartment", "rent", "mortgage")),
    Rule(("Food",), keywords=("recipe", "cook", "food"), min_score=1.0, fallback=True),
    Rule(("Technology",), keywords=("software", "ai", "app"), min_score=1.0, fallback=True),
)


def norm(c: Column) -> Column:
    """Lower case, other than word characters and + . # ' _ - as single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\w+.#'-]+", " "))


def taxonomy_fields(memories: DataFrame, items: DataFrame, tags: DataFrame, segments: DataFrame) -> DataFrame:
    """(memory_id, field, text) of the fields with text: title, caption and creator of the item, tags, and one
    per modality (contents in order of segment_id); a modality named like a field replaces that field."""
    own = memories.select("memory_id", F.lit("title").alias("field"), norm(F.col("title")).alias("text"))
    for c in ("caption", "creator"):
        own = own.unionByName(items.select("memory_id", F.lit(c).alias("field"), norm(F.col(c)).alias("text")))
    tagged = tags.groupBy("memory_id").agg(F.array_sort(F.collect_set("tag")).alias("t")).select("memory_id", F.lit("tags").alias("field"), norm(F.array_join("t", " ")).alias("text"))
    # contents are normalized before they are gathered; a memory has few segments
    parts = segments.groupBy("memory_id", F.col("modality").alias("field")).agg(F.sort_array(F.collect_list(F.struct("segment_id", norm(F.col("content")).alias("c")))).alias("rows"))
    spoken = parts.select("memory_id", "field", F.array_join(F.filter(F.transform("rows", lambda r: r["c"]), lambda c: c != ""), " ").alias("text"))
    kept = own.unionByName(tagged).join(spoken.select("memory_id", "field"), ["memory_id", "field"], "left_anti")
    return kept.unionByName(spoken).where("text <> ''")


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """A tuple of rules as a table, in its order."""
    return spark.createDataFrame([(i, list(r.path), list(r.strong), list(r.keywords), r.min_score, r.fallback) for i, r in enumerate(rules)], RULES_SCHEMA)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rule table of a file or folder of JSON lines with the columns of RULES_SCHEMA; what a line leaves out is
    empty, 3.0 or false. A number that two rules share, or a rule without a path, is an error."""
    read = spark.read.schema(RULES_SCHEMA).json(path)
    none = F.array().cast("array<string>")
    table = read.select("rule", "path", F.coalesce("strong", none).alias("strong"), F.coalesce("keywords", none).alias("keywords"), F.coalesce("min_score", F.lit(3.0)).alias("min_score"), F.coalesce("fallback", F.lit(False)).alias("fallback"))
    bad = table.groupBy("rule").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size("path"), F.lit(0)) <= 0).alias("bare")).where("rule IS NULL OR n > 1 OR bare > 0").first()
    if bad is not None:
        raise ValueError(f"rule {bad.rule}: {bad.n} rows, {bad.bare} of them without a path")
    return table


def _as_table(spark: SparkSession, rules: tuple[Rule, ...] | DataFrame) -> DataFrame:
    return rules if isinstance(rules, DataFrame) else rule_table(spark, rules)


def rule_terms(rules: DataFrame) -> DataFrame:
    """(rule, kind, term) of a rule table: normalized terms, each as often as its rule lists it; keywords of several words
    are phrases, terms without a word are left out."""
    strong = rules.select("rule", F.lit("strong").alias("kind"), F.explode("strong").alias("t"))
    single = rules.select("rule", F.lit("keyword").alias("kind"), F.explode("keywords").alias("t"))
    all_ = strong.unionByName(single).select("rule", "kind", norm(F.col("t")).alias("term")).where("term <> ''")
    return all_.withColumn("kind", F.when((F.col("kind") == "keyword") & F.contains("term", F.lit(" ")), "phrase").otherwise(F.col("kind")))


def _matcher(terms: list) -> Callable[[str], dict]:
    """From (rule, kind, term) a function of a normalized text: rule to the summed factors of its terms in the text."""
    words, phrases = {}, {}
    for rule, kind, term in terms:
        (words if kind == "keyword" else phrases).setdefault(term, []).append((rule, FACTORS[kind]))
    automaton = ahocorasick.Automaton()
    for term, told in phrases.items():
        automaton.add_word(term, told)
    if phrases:
        automaton.make_automaton()

    def match(text: str) -> dict:
        # a blank-separated part is one word, without the marks before its first letter or digit
        found = [words[w] for w in {w.lstrip("+.#'_-") for w in set(text.split(" "))} if w in words]
        if phrases:
            found += {id(told): told for _, told in automaton.iter(text)}.values()
        out: dict = {}
        for told in found:
            for rule, factor in told:
                out[rule] = out.get(rule, 0.0) + factor
        return out

    return match


def _field_hits(fields: DataFrame, terms: list) -> DataFrame:
    """(memory_id, rule, s): a row of each field and rule with a hit, and one without a rule for each field without any."""
    told = fields.sparkSession.sparkContext.broadcast(terms)
    schema = fields.select("memory_id", F.lit(None).cast("int").alias("rule"), F.lit(0.0).alias("s")).schema
    id_type = to_arrow_type(schema["memory_id"].dataType)

    def run(batches):
        match = _matcher(told.value)
        for part in (batch.slice(k, SLICE) for batch in batches for k in range(0, batch.num_rows, SLICE)):
            ids, rules, sums = [], [], []
            for i, text, weight in zip(*(part.column(n).to_pylist() for n in range(3))):
                hits = match(text) or {None: 0.0}
                ids += [i] * len(hits)
                rules += hits.keys()
                sums += [weight * f for f in hits.values()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(rules, pa.int32()), pa.array(sums, pa.float64())], ["memory_id", "rule", "s"])

    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FIELD_WEIGHTS.items() for x in kv]), F.col("field")), F.lit(1.0))
    return fields.where(F.col("text").isNotNull()).select("memory_id", "text", weight.alias("weight")).mapInArrow(run, schema)


def rule_scores(fields: DataFrame, rules: tuple[Rule, ...] | DataFrame, unmatched: bool = False) -> DataFrame:
    """(memory_id, rule, score) of the rules with any hit; with `unmatched`, memories that have a field without a
    hit get a row without rule and score besides, so that classify() need not read the texts again. Phrases count anywhere in a field's text, keywords as
    whole words, each once a field. Terms are dealt to blocks of about TERM_BYTES by a hash of (rule, term); the driver
    reads and sends one block at a time, tasks pass over the texts once for each, and hits are summed by rule before and in the shuffle."""
    table = _as_table(fields.sparkSession, rules)
    terms = rule_terms(table)
    size = terms.agg(F.sum(F.length("term") + 16)).first()[0] or 0
    blocks, hits = max(1, -(-size // TERM_BYTES)), None
    for b in range(blocks):
        part = terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("rule", "term"), F.lit(blocks)) == b)
        found = _field_hits(fields, [tuple(r) for r in part.collect()])
        hits = found if hits is None else hits.unionByName(found)
    sums = (hits if unmatched else hits.where("rule IS NOT NULL")).groupBy("memory_id", "rule").agg(F.sum("s").alias("s"))
    bonus = table.select("rule", (F.greatest(F.lit(0), F.size("path") - 2) * 0.4).alias("bonus"))
    return sums.join(bonus, "rule", "left").select("memory_id", "rule", F.round(F.col("s") + F.col("bonus"), 3).alias("score"))


def _about(rules: tuple[Rule, ...] | DataFrame, scores: DataFrame) -> DataFrame:
    """scores with path, depth, root, min_score and fallback of their rules."""
    table = _as_table(scores.sparkSession, rules).select("rule", "path", "min_score", "fallback")
    return scores.join(table, "rule").withColumns({"depth": F.size("path"), "root": F.get("path", F.lit(0))})


def _candidates(scores: DataFrame, rules: tuple[Rule, ...] | DataFrame) -> DataFrame:
    """Scores that count, ranked: those of rules that reach their least score, or of fallbacks if none does."""
    known = _about(rules, scores).where("score >= min_score")
    real = F.bool_or(~F.col("fallback")).over(Window.partitionBy("memory_id"))
    order = Window.partitionBy("memory_id").orderBy(F.desc("score"), F.desc("depth"), "rule")
    return known.withColumn("real", real).where("fallback <> real").withColumns({"n": F.row_number().over(order), "next": F.coalesce(F.lead("score").over(order), F.lit(0.0)), "best": F.first("score").over(order), "best_root": F.first("root").over(order)})


def classify(memories: DataFrame, fields: DataFrame | None, scores: DataFrame, rules: tuple[Rule, ...] | DataFrame) -> DataFrame:
    """(memory_id, path, score, confidence) of every memory; what has no rule is Other/Uncategorized. Without
    `fields`, scores tell which memories have text: those of rule_scores(..., unmatched=True)."""
    best = _candidates(scores, rules).where("n = 1")
    margin = F.greatest(F.lit(0.0), F.col("score") - F.col("next"))
    sure = F.round(F.least(F.lit(0.98), 0.58 + F.least("score", F.lit(35.0)) / 100 + F.least(margin, F.lit(20.0)) / 80), 3)
    named = best.select("memory_id", F.array_join("path", "/").alias("p"), "score", sure.alias("c"))
    content = (scores if fields is None else fields).select("memory_id").distinct().withColumn("content", F.lit(True))
    out = memories.select("memory_id").join(named, "memory_id", "left").join(content, "memory_id", "left")
    return out.select("memory_id", F.coalesce("p", F.lit("Other/Uncategorized")).alias("path"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("c", F.when(F.col("content"), 0.35).otherwise(0.20)).alias("confidence"))


def secondary_paths(scores: DataFrame, decisions: DataFrame, rules: tuple[Rule, ...] | DataFrame) -> DataFrame:
    """T4: (memory_id, path, confidence): up to two paths of other roots that score near the best."""
    near = _candidates(scores, rules).where("n > 1 and root <> best_root").where(F.col("score") >= F.greatest(F.col("min_score"), F.col("best") * 0.58))
    two = near.withColumn("k", F.row_number().over(Window.partitionBy("memory_id").orderBy("n"))).where("k <= 2")
    primary = decisions.select("memory_id", (F.col("confidence") - 0.12).alias("c"))
    return two.join(primary, "memory_id").select("memory_id", F.array_join("path", "/").alias("path"), F.round(F.greatest(F.lit(0.40), F.col("c")), 3).alias("confidence"))


def _prefixes(path: Column) -> Column:
    """The paths of a node's ancestors and itself."""
    names = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, 1, k), "/"))


def category_nodes(decisions: DataFrame) -> DataFrame:
    """T5: (user_id, path, name, depth, parent_path) of every category that a path passes through."""
    nodes = decisions.select("user_id", "path").distinct().select("user_id", F.explode(_prefixes(F.col("path"))).alias("path")).distinct()
    names = F.split("path", "/")
    parent = F.nullif(F.array_join(F.slice(names, 1, F.size(names) - 1), "/"), F.lit(""))
    return nodes.select("user_id", "path", F.element_at(names, -1).alias("name"), (F.size(names) - 1).alias("depth"), parent.alias("parent_path"))


def merge_assignments(existing: DataFrame, desired: DataFrame) -> DataFrame:
    """Assignments (memory_id, path, is_primary, confidence, source) after a run: memories with a manual primary
    keep theirs; others get what is desired, and lose what isn't."""
    manual = existing.where("is_primary and source = 'manual'").select("memory_id").distinct()
    kept = existing.join(manual, "memory_id", "left_semi")
    return kept.unionByName(desired.join(manual, "memory_id", "left_anti").select(existing.columns))


def reclassify_counts(decisions: DataFrame) -> DataFrame:
    """(path, n), most first, paths written with ' > '."""
    return decisions.groupBy(F.replace("path", F.lit("/"), F.lit(" > ")).alias("path")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path")


def category_tree(assignments: DataFrame) -> DataFrame:
    """(user_id, path, depth, direct, total) of primary assignments: a row per node above each; nodes without any
    do not occur. One aggregate, combined before its shuffle."""
    up = assignments.where("is_primary").select("user_id", "path", F.explode(_prefixes(F.col("path"))).alias("node"))
    g = up.groupBy("user_id", F.col("node").alias("path")).agg(F.count_if(F.col("node") == F.col("path")).alias("direct"), F.count("*").alias("total"))
    return g.select("user_id", "path", (F.size(F.split("path", "/")) - 1).alias("depth"), "direct", "total")


def category_paths(assignments: DataFrame) -> DataFrame:
    """(memory_id, categories): paths with ' > ', the primary first, then by name."""
    row = F.struct((~F.col("is_primary")).alias("later"), F.replace("path", F.lit("/"), F.lit(" > ")).alias("path"))
    return assignments.groupBy("memory_id").agg(F.transform(F.sort_array(F.collect_set(row)), lambda r: r["path"]).alias("categories"))


def in_subtree(memories: DataFrame, assignments: DataFrame, path: str) -> DataFrame:
    """Memories whose primary category is path or below it."""
    under = assignments.where(F.col("is_primary") & ((F.col("path") == path) | F.col("path").startswith(path + "/")))
    return memories.join(under.select("memory_id"), "memory_id", "left_semi")


def classifier_eval(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(expected_path, path, n, correct): the confusion counts; memories without a prediction count as null."""
    met = truth.join(predicted.select("memory_id", "path"), "memory_id", "left")
    return met.groupBy("expected_path", "path").agg(F.count("*").alias("n"), F.count_if(F.col("path") == F.col("expected_path")).alias("correct"))
