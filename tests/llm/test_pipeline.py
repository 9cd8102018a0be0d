"""The pipeline against its stages done plainly, and the registration of all queries."""

import re

import public_tokenizers as P
import tokenizers
from pyspark.sql import functions as F

from larder.llm import toxicity
from tests.llm.test_pii import brute
from tests.llm.test_simhash import plain_fingerprint


def test_stages(spark, tmp_path):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    whole = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    scores = toxicity.toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert set(kept["toxicity"]) == {r.doc_id for r in scores.collect() if r.score < 0.5}
    fps = {d: plain_fingerprint(t) for d, t in kept["toxicity"].items()}
    reached: dict = {}
    for d in sorted(fps):
        near = [e for e in sorted(reached) if (fps[d] ^ fps[e]).bit_count() <= 4]
        reached[d] = min([reached[e] for e in near], default=d)
        for e, c in reached.items():
            if c in {reached[n] for n in near}:
                reached[e] = reached[d]
    assert set(kept["simhash"]) == set(reached.values())
    for d, text in kept["pii"].items():
        before = whole[d]
        if not brute(before)[1]:
            assert text == before or re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", text)
        else:
            assert not brute(text)[1]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    encode = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode
    assert sum(r.length for r in packed) == sum(len(encode(t, add_special_tokens=False).ids) + 1 for t in kept["pii"].values())
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed)


def test_columns_of_any_name_pass_every_stage(spark, tmp_path):
    """Names that the stages use inside are the user's here."""
    import corpus_pipeline

    sf_dir, names = "/root/testdata/sf0.001", ["__email", "__spans", "__found", "__row", "__fp", "__score", "__text", "__group", "own", "fp", "row", "score", "spans", "a.b"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).unionByName(spark.createDataFrame([(10**6, None, None, None, None), (None, "", "", "", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    for n in names:
        docs = docs.withColumn(n, F.concat_ws("-", F.lit(n), F.col("doc_id").cast("string")))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        for r in docs.collect():
            assert all(r[n] == "-".join([n, *([str(r.doc_id)] if r.doc_id is not None else [])]) for n in names), name
    assert docs.count() > 20
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(re.match(rf"op{n}_", x) for x in names) for n in range(1, 11))
    assert set(entry.oracle_sql()) <= names
