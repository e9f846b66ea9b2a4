import corpus_pipeline
from tests_llm_brute import contaminated, keepers

from tidelog.llm import secrets


def test_stages_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    by_name = dict(corpus_pipeline.STAGES)
    first = by_name["language ID"](spark, docs, sf)
    assert first.schema == docs.schema and first.count() >= 0.98 * docs.count()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = by_name["SimHash near-dedup"](spark, docs, sf)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == keepers(rows)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    clean = by_name["benchmark decontamination"](spark, docs, sf)
    assert clean.schema == docs.schema and sorted(r.doc_id for r in clean.collect()) == sorted(x[0] for x in contaminated(rows, items) if not x[3])
    masked = by_name["secret scans"](spark, docs, sf)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    assert not secrets.find_secrets(masked, to="found").where("size(found) > 0").count()
    assert all(r.n_chars == len(r.text) for r in masked.where("text like '%[SECRET]%'").collect())


def test_run(spark, sf, frame):
    got = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame([]), sf).count() == 0, name
        assert stage(spark, frame([(None, None), (1, ""), (1, "one two three"), (1, "one two three"), (2, "word " * 30_000)]), sf).count() >= 1, name
