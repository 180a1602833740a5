"""The pipeline's stages against brute force, each on what its predecessor kept."""

import hashlib

import sentencepiece

import corpus_pipeline
from quantloom.llm import common, pieces, quality, secrets
from tests.llm.test_operators import brute_contamination, brute_fingerprint, brute_groups

FOLDER = "/root/testdata/sf0.001"


def test_stages_follow_their_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "pieces"]


def test_pipeline_equals_brute_force(spark):
    docs, labels, bench = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    good = {r["doc_id"] for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    rows = [r for r in docs.orderBy("doc_id").collect() if r["doc_id"] in good]
    groups = brute_groups([r["doc_id"] for r in rows], [brute_fingerprint(r["text"]) for r in rows])
    rows = [r for r, g in zip(rows, groups) if r["doc_id"] == g]
    bad = {w[0] for w in brute_contamination([(r["doc_id"], r["text"]) for r in rows], [(r["item_id"], r["text"]) for r in bench.collect()]) if w[5]}
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = {}
    for r in rows:
        if r["doc_id"] not in bad:
            text = secrets.redact(r["text"])
            want[r["doc_id"]] = (lib.encode(text), hashlib.sha256(text.encode()).hexdigest())
    got = {r["doc_id"]: (list(r["ids"]), r["text_sha256"]) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == want


def test_stages_keep_columns_and_take_any_input(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = docs.limit(3).union(spark.createDataFrame([(None, None, None, None, None), (7, "", "en", "s", 0), (7, "", "en", "s", 0)], docs.schema))
    for given in (odd, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, given, FOLDER)
            assert out.columns == docs.columns, name
            assert out.count() <= given.count()


def test_clashing_columns_and_release(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(20)
    odd = docs.selectExpr("*", *[f"1 as {c}" for c in ("_key", "id", "fp", "component", "_starts", "_n_words", "spans", "hit", "total", "c0", "score", "x", "y", "label")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, FOLDER)
        assert out.columns == odd.columns and out.count() <= 20, name
    assert common.free(odd, "_KEY", "new") == ["__KEY", "new"]
    assert common.release(spark) > 0 and common.release(spark) == 0
