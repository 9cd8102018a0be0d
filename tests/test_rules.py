"""Rule tables: loading, blocks of terms, and scores against plain loops."""

from __future__ import annotations

import json
import random
import re

import pytest

from larder.operators import taxonomy


def slow(text: str, rule: dict) -> float:
    norm = lambda t: " ".join(re.sub(r"[^a-z0-9+.#'_-]+", " ", t.lower()).split())
    words, out = set(re.findall(r"[a-z0-9][a-z0-9+.#'_-]*", text)), 0.0
    for t in map(norm, rule["strong"]):
        out += 2.0 if t and t in text else 0
    for t in map(norm, rule["keywords"]):
        out += (1.1 if t in text else 0) if " " in t else (0.7 if t and t in words else 0)
    return out


@pytest.fixture
def rules():
    rng = random.Random(3)
    bits = ["a", "ab", "c++", "x.y", "-dash", "it's", "é", "of", "#tag", "b2b", "", "..."]
    pick = lambda n: [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    return [{"rule": i, "path": ["R", str(i % 5), str(i)][: 1 + i % 3], "strong": pick(i % 4), "keywords": pick(3) + ["same", "same"], "min_score": 1.0, "fallback": i % 7 == 0} for i in range(500)]


@pytest.mark.parametrize("block", [taxonomy.TERM_BYTES, 6_000])
def test_a_table_of_500_rules_in_one_block_and_in_many(spark, rules, tmp_path, monkeypatch, block):
    monkeypatch.setattr(taxonomy, "TERM_BYTES", block)
    (tmp_path / "rules.json").write_text("\n".join(map(json.dumps, rules)))
    table = taxonomy.load_rules(spark, str(tmp_path / "rules.json"))
    texts = ["same", "ab of ab", "c++ x.y -dash it's", "#tag b2b of a", "nothing here", "xaby same -dash", ""]
    fields = spark.createDataFrame([(m, f, t) for m, f in enumerate(("title", "speech", "odd")) for t in texts], "memory_id int, field string, text string")
    weights = {0: 6.0, 1: 1.5, 2: 1.0}
    want = {}
    for m, w in weights.items():
        for r in rules:
            s = sum(w * slow(t, r) for t in texts)
            if s:
                want[m, r["rule"]] = round(s + max(0, len(r["path"]) - 2) * 0.4, 3)
    got = {(r.memory_id, r["rule"]): r.score for r in taxonomy.rule_scores(fields, table).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.0011 for k in want)


def test_unmatched_texts_are_told_from_missing_ones(spark):
    rules = (taxonomy.Rule(("A", "B"), strong=("one two",), min_score=1.0),)
    fields = spark.createDataFrame([(1, "title", "one two"), (2, "title", "three")], "memory_id int, field string, text string")
    memories = spark.createDataFrame([(1,), (2,), (3,)], "memory_id int")
    scores = taxonomy.rule_scores(fields, rules, unmatched=True)
    got = {r.memory_id: (r.path, r.confidence) for r in taxonomy.classify(memories, None, scores, rules).collect()}
    again = {r.memory_id: (r.path, r.confidence) for r in taxonomy.classify(memories, fields, taxonomy.rule_scores(fields, rules), rules).collect()}
    assert got == again == {1: ("A/B", 0.85), 2: ("Other/Uncategorized", 0.35), 3: ("Other/Uncategorized", 0.2)}


def test_a_table_with_two_rules_of_one_number_is_an_error(spark, tmp_path):
    (tmp_path / "rules.json").write_text('{"rule": 1, "path": ["A"]}\n{"rule": 1, "path": ["B"]}')
    with pytest.raises(ValueError, match="rule 1"):
        taxonomy.load_rules(spark, str(tmp_path / "rules.json"))


def test_no_rules_and_no_texts(spark):
    fields = spark.createDataFrame([(1, "title", "one")], "memory_id int, field string, text string")
    assert taxonomy.rule_scores(fields, ()).count() == 0
    assert taxonomy.rule_scores(fields.limit(0), taxonomy.EXAMPLE_RULES).count() == 0
