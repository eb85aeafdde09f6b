import corpus_pipeline
from pagequern.llm import decontaminate, exact_dedup, jaccard_join, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, bench = docs.columns, spark.read.parquet(f"{SF}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "source mix"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept = {r.doc_id for r in docs.collect()}
        if i < 4:
            assert docs.columns == columns
        if i == 0:
            assert kept == {r.doc_id for r in toxicity.score(before, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 0").collect()}
        elif i == 1:
            assert kept == {r.doc_id for r in exact_dedup.decide(before).where("kept").collect()}
        elif i == 2:
            found = jaccard_join.cluster(before).collect()
            assert kept == {r.doc_id for r in found if r.doc_id == r.component_id}
        elif i == 3:
            assert kept == {r.doc_id for r in before.collect()} - {r.doc_id for r in decontaminate.leaks(before, bench).collect()}
        else:
            assert {"size", "source_size", "target", "taken"} <= set(docs.columns) and docs.where("taken <= 0 OR taken > 3 * size").count() == 0


def test_run_agrees_with_itself(spark):
    rows = [sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "taken").collect())) for _ in range(2)]
    assert rows[0] == rows[1] and rows[0]


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
