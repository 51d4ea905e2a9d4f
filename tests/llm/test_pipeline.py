import corpus_pipeline
from quirework.llm import common, queries


def test_stages_keep_the_columns_and_take_effect(spark, small):
    docs = common.read_table(spark, small, "documents")
    counts, at = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES:
        out = common.cut(stage(spark, at, small), f"test-{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
            assert {r[0] for r in out.select("doc_id").collect()} <= {r[0] for r in at.select("doc_id").collect()}
            again = stage(spark, out, small)
            if name in ("ngram_jaccard", "decontamination"):
                assert again.count() == out.count(), name
        at = out
        counts.append(out.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] < counts[0]
    whole = corpus_pipeline.run(spark, small)
    key = lambda df: sorted((r["doc_id"], r["ids_sha256"]) for r in df.collect())
    assert key(whole) == key(at)


def test_stages_on_nothing(spark, small):
    docs = common.read_table(spark, small, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
