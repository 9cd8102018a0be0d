"""URL filters: rules by host and path, and a path-template tree for what no rule judges.

A url's path becomes a template in three steps, each an aggregate over counts and never over rows of one host:

1. segments that vary by their form (numbers, long hex or mixed tokens) become {n} and {x}; their endings stay;
2. from the root down, every segment is counted below the template of what is above it; it stays as it is where it
   holds at least SHARE of its parent's pages and LEAST pages, else it becomes *. So a node has at most 1 / SHARE
   literal branches. Segments behind DEPTH levels become one **;
3. literal branches of one parent are compared, level by level from the deepest: those with the same commonest
   continuation that lean to the same side (mostly blocked or not) are held against their common distribution of
   continuations (chi-square) and their common rate of blocked pages. Those that differ by no more than chance does
   become one branch, {a|b}.

Labels are pages that the rules judge (or a column of the caller's). A template's purity is its share of blocked pages among
its labelled ones, smoothed by PRIOR pages of the whole table's rate. Pages of a template are blocked where purity reaches
PURITY, on at least LEAST labelled pages that are at least COVERAGE of the template's pages: labels of a minority of a
template say nothing about its rest. All else is allowed.

Rules come as (verdict, "host/path"): a rule fits its host and all subdomains where the url's path starts with its
path; the longest wins, of equally long ones the smaller text. They are a configuration and travel in the plan.

Hot hosts: counts are combined before each shuffle, and joins have an exchange on both sides, so adaptive execution
splits a host with a third of all rows.

Defined results: a null url and one without :// have an empty host and path, fit no rule and are allowed (they take
part in no template). A url with an empty path fits no rule, as every rule's path starts with /. Repeated rows count
as often as they occur; a null page_id is a row as any other. Very long urls are read whole. An empty table gives an empty result. Extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.columns import named
from larder.session import staged

SHARE = 0.02
LEAST = 20
DEPTH = 4
PRIOR = 10.0
PURITY = 0.9
COVERAGE = 0.5
SIGMAS = 3.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    behind = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    behind = F.coalesce(behind, F.lit(""))
    host = F.regexp_extract(behind, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(behind, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    name = verdict = F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        at = rule.index("/")
        own = rule[:at]
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(rule[at:]))
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def shaped(path: Column) -> Column:
    """Step 1: numbers and long tokens of a path as {n} and {x}."""
    tokens = F.regexp_replace(path, r"[0-9A-Fa-f]{8,}(-[0-9A-Fa-f]+)*", "{x}")
    return F.regexp_replace(tokens, r"[0-9]+", "{n}")


def segments_of(shape: Column) -> Column:
    return F.split(F.substring(shape, 2, F.length(shape)), "/")


def templates(paths: DataFrame, deepest: int = DEPTH) -> DataFrame:
    """Step 2. paths: (host, shape, n), one row of each shape. Gives (host, shape, parts).

    From the root down: a level's segments are counted behind what the levels above have become, so that all names
    below one wildcard count together. A node hands down at most 1 / SHARE literal names.
    """
    now = paths.select("host", "shape", "n", segments_of(F.col("shape")).alias("segments"), F.array().cast("array<string>").alias("parts"))
    for level in range(min(DEPTH, deepest)):
        own = now.withColumn("s", F.get("segments", F.lit(level)))
        counts = own.where("s IS NOT NULL").groupBy("host", "parts", "s").agg(F.sum("n").alias("n"))
        totals = own.groupBy("host", "parts").agg(F.sum("n").alias("total"))
        literal = counts.join(totals, ["host", "parts"]).where((F.col("n") >= LEAST) & (F.col("n") >= SHARE * F.col("total")))
        names = literal.groupBy("host", "parts").agg(F.collect_set("s").alias("names"))
        known = F.col("s").contains("{") | (F.col("s") == "") | F.coalesce(F.array_contains("names", F.col("s")), F.lit(False))
        longer = F.concat("parts", F.array(F.when(known, F.col("s")).otherwise("*")))
        met = own.join(names, ["host", "parts"], "left")
        now = staged(met.select("host", "shape", "n", "segments", F.when(F.col("s").isNull(), F.col("parts")).otherwise(longer).alias("parts")), "urls-level")
    return now.select("host", "shape", F.when(F.size("segments") > DEPTH, F.concat("parts", F.array(F.lit("**")))).otherwise(F.col("parts")).alias("parts"))


def merged(trees: DataFrame, deepest: int = DEPTH) -> DataFrame:
    """Step 3. trees: (host, parts, n, labelled, blocked), one row of each template; a host has at most
    (1 / SHARE + few) ** DEPTH of them, whatever its pages. Gives trees with `template`: parts with merged branches."""
    now = trees.withColumn("template", F.col("parts"))
    over = lambda *keys: Window.partitionBy("host", "pre", *keys)
    for level in range(min(DEPTH, deepest), 0, -1):
        suffix = F.slice("template", F.lit(level + 1), F.greatest(F.size("template") - level, F.lit(0)))
        now = now.withColumns({"b": F.get("template", F.lit(level - 1)), "pre": F.slice("template", 1, level - 1), "suf": suffix})
        # wildcards, and templates that end before this level, are no branches to compare
        flat = now.where("b IS NOT NULL AND NOT contains(b, '{') AND NOT contains(b, '*')").groupBy("host", "pre", "b", "suf").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
        sums = lambda *keys, **of: {k: F.sum(c).over(over(*keys)) for k, c in of.items()}
        form = F.first("suf").over(over("b").orderBy(F.desc("n"), F.desc("suf")))
        formed = flat.withColumn("form", form).withColumns(sums("b", branch_n="n", branch_l="labelled", branch_b="blocked") | sums("form", form_l="labelled", form_b="blocked"))
        # compared are branches of one commonest suffix that lean to one side; one without labels leans as the others do
        sided = formed.withColumn("side", F.when(F.col("branch_l") > 0, 2 * F.col("branch_b") > F.col("branch_l")).otherwise(2 * F.col("form_b") > F.col("form_l")))
        group = ("form", "side")
        counted = sided.withColumns(sums(*group, all_n="n", all_l="labelled", all_b="blocked") | sums(*group, "suf", suf_n="n") | {"kinds": F.size(F.collect_set("suf").over(over(*group)))})
        alone = ("branch_n", "branch_l", "branch_b", "all_n", "all_l", "all_b", "kinds")
        expected = F.col("branch_n").cast("double") * F.col("suf_n") / F.col("all_n")
        one = counted.groupBy("host", "pre", "b", *group).agg(F.sum(F.col("n") * F.col("n") / expected).alias("fit"), *[F.first(c).alias(c) for c in alone])
        free = F.greatest(F.col("kinds") - 1, F.lit(1))
        rate = F.when(F.col("all_l") > 0, F.col("all_b") / F.col("all_l")).otherwise(0.0)
        apart = F.abs(F.col("branch_b") - F.col("branch_l") * rate)
        alike = (F.col("fit") - F.col("branch_n") <= free + SIGMAS * F.sqrt(2.0 * free)) & (apart <= SIGMAS * F.sqrt(F.col("branch_l") * rate * (1 - rate)) + 0.5)
        names = F.array_sort(F.collect_set("b").over(over(*group)))
        several = one.where(alike).select("host", "pre", "b", names.alias("names")).where(F.size("names") > 1)
        new = F.concat("pre", F.array(F.concat(F.lit("{"), F.array_join("names", "|"), F.lit("}"))), "suf")
        met = now.join(several, ["host", "pre", "b"], "left")
        # each level reads what the one above wrote: its rows meet their own aggregates
        now = staged(met.select("host", "parts", "n", "labelled", "blocked", F.when(F.col("names").isNotNull(), new).otherwise(F.col("template")).alias("template")), "urls-merged")
    return now


def judged(pages: DataFrame, rules: list[tuple[str, str]], page_id: str = "page_id", url: str = "url", label: Column | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity). `label` (1 blocked, 0 allowed, null unknown) takes the
    place of the rules' verdicts as what templates learn from."""
    host, path = host_and_path(named(url))
    own = pages.select(named(page_id).alias("page_id"), host.alias("host"), path.alias("path"), (F.lit(None) if label is None else label).cast("int").alias("given"))
    rule, said = fitting_rule(F.col("host"), F.col("path"), rules)
    known = own.withColumns({"rule": rule, "said": said, "shape": shaped(F.col("path"))})
    mark = F.when(F.col("said").isNotNull(), (F.col("said") == "block").cast("int")) if label is None else F.col("given")
    counted = known.where("host <> ''").groupBy("host", "shape").agg(F.count("*").alias("n"), F.count(mark).alias("labelled"), F.coalesce(F.sum(mark), F.lit(0)).alias("blocked"))
    counted = staged(counted, "urls-counted")
    total = counted.agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.max(F.size(segments_of(F.col("shape")))).alias("deepest")).first()
    deepest = total.deepest or 0  # no level below it has a segment
    rate = F.lit(float(total.b) / total.l if total.l else 0.0)
    first = templates(counted, deepest)
    trees = first.join(counted, ["host", "shape"]).groupBy("host", "parts").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
    last = merged(trees, deepest)
    pure = last.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
    pure = pure.withColumn("purity", F.round((F.col("blocked") + PRIOR * rate) / (F.col("labelled") + PRIOR), 6))
    pure = pure.select("host", "template", "purity", ((F.col("purity") >= PURITY) & (F.col("labelled") >= LEAST) & (F.col("labelled") >= COVERAGE * F.col("n"))).alias("rejected"))
    shapes = first.join(last.select("host", "parts", "template"), ["host", "parts"]).join(pure, ["host", "template"])
    told = shapes.select("host", "shape", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity", "rejected")
    verdict = F.coalesce("said", F.when(F.col("rejected"), "block"), F.lit("allow"))
    return known.join(told, ["host", "shape"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
