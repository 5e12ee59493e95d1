import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from mediatally.llm import decontaminate, toxicity

from .conftest import table_rows
from .test_exactdedup import simple as exact
from .test_simhash import classes, simple_fingerprint

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    rows = {r.doc_id: r.text for r in table_rows(spark, "documents", "sf0.01")}
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, toxicity.fit(docs, labels)).collect()}
    rows = {i: t for i, t in rows.items() if scores[i] < 0.5}
    kept = {r[0] for r in exact(list(rows.items())) if r[3]}
    rows = {i: t for i, t in rows.items() if i in kept}
    ids = sorted(rows)
    label = classes([simple_fingerprint(rows[i]) for i in ids])
    rows = {i: rows[i] for k, i in enumerate(ids) if label[k] == k}
    words = lambda t: f" {' '.join(decontaminate.Words([t or '']).between(0, 10**9))} "
    items = [words(r.text) for r in table_rows(spark, "benchmark", "sf0.01")]
    rows = {i: t for i, t in rows.items() if not any(x in words(t) for x in items)}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows.items()}
    found = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.ids for r in found} == want
    assert all(r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() and r.n_tokens == len(r.ids) for r in found)


def test_stages_keep_columns_and_take_odd_rows(spark, odd_docs, no_docs):
    for docs, most in ((odd_docs, 14), (no_docs, 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= most
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == most


def test_without_keeps_as_many_rows_as_verdicts_say(spark):
    from mediatally.llm.common import without

    docs = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "b", "x"), (None, "c", "x"), (None, None, "y"), (3, "d", "x")], "doc_id long, text string, hit string")
    hashed = docs.selectExpr("doc_id", "xxhash64(coalesce(text, '')) as text_hash", "text")
    drop = hashed.where("text = 'b' or doc_id is null").selectExpr("doc_id", "text_hash", "text is null as kept")
    first = spark.createDataFrame([(1, True), (1, False)], "doc_id long, kept boolean").join(hashed.where("doc_id = 1").select("text_hash").distinct())
    left = without(docs, drop.unionByName(first.select("doc_id", "text_hash", "kept")), bits=1 << 15)
    assert left.columns == docs.columns
    assert sorted(map(repr, left.collect())) == sorted(map(repr, [r for r in docs.collect() if r.text in ("d", None)] + [docs.where("doc_id = 1").first()]))


def test_worker_keeps_one_operators_tables():
    from mediatally.llm import common

    made = []
    for key in (("a",), ("a",), ("b",), ("a",)):
        common.kept_in_worker(key, lambda: made.append(key) or {})
    assert made == [("a",), ("b",), ("a",)] and list(common.KEPT) == [("a",)]


def test_worker_gives_back_what_arrow_holds(monkeypatch):
    """Once for each change of operator, not for each look-up."""
    from mediatally.llm import common

    released = []

    class Pool:
        def release_unused(self):
            released.append(1)

    monkeypatch.setattr(common, "KEPT", {})
    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    for key in (("a",), ("a",), ("b",), ("b",)):
        common.kept_in_worker(key, dict)
    assert len(released) == 2
