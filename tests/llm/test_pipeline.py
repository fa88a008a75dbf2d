import corpus_pipeline
from assetloom.llm.common import materialise, table
from assetloom.llm.exact_dedup import exact_dedup
from assetloom.llm.simhash import near_dedup

SF = "/root/testdata/sf0.01"


def test_stages_take_effect_and_keep_columns(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    assert len(corpus_pipeline.STAGES) == 5
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = materialise(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        counts.append(docs.count())
        if name == "exact_dedup":
            assert counts[-1] == exact_dedup(before).filter("kept").count()
        if name == "simhash_near_dedup":
            want = {r.component_id for r in near_dedup(before).collect()}
            assert {r.doc_id for r in docs.collect()} == want
        if name == "secret_scan":
            texts = [r.text for r in docs.collect()]
            assert len(texts) == counts[-2] and any("<secret>" in t for t in texts) and not any('token = "' in t for t in texts)
            assert docs.filter("n_chars <> length(text)").count() == before.filter("n_chars <> length(text)").count()
    assert counts[0] >= 990 and counts[1] < counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_stages_take_empty_tables(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        if stage is not corpus_pipeline.packed:
            assert stage(spark, docs, SF).count() == 0
