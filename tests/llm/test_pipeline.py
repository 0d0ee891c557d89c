"""The pipeline's stages, each on what the one before kept."""

import corpus_pipeline
from tidegate.llm import decontaminate, jaccard_join, paragraph_dedup, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(out)
        after = spark.read.parquet(out)
        if number == len(corpus_pipeline.STAGES) - 1:
            assert {r.doc_id for r in after.collect()} == set(kept)
            break
        assert after.columns == columns
        rows = {r.doc_id: r.text for r in after.collect()}
        if name == "toxicity":
            model = toxicity.fit_documents(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            want = {r.doc_id for r in toxicity.score_documents(docs, model).filter("predicted = 0").collect()}
            assert set(rows) == want
        elif name == "jaccard_join":
            assert set(rows) == {r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
        elif name == "substring_dedup":
            cut = {r.doc_id: r.kept for r in paragraph_dedup.remove_paragraphs(docs).collect()}
            assert rows == {i: t for i, t in cut.items() if i in rows} and all(not cut[i].split() for i in cut if i not in rows)
        elif name == "decontamination":
            found = decontaminate.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert set(rows) == {r.doc_id for r in found.filter("not contaminated").collect()}
        docs, kept = after, rows


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
