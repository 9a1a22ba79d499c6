import __spark_entry__
import corpus_pipeline
from cadenza.llm import registry


def test_stages_chain_and_keep_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert counts == sorted(counts, reverse=True) and 0 < counts[-1] < counts[0]
    assert corpus_pipeline.run(spark, sf_dir).count() == counts[-1]


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and "pipeline" in names


def test_quality_stage_rejects_labelled_junk_and_keeps_labelled_clean_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("size(split(trim(text), '[ \\t-\\r]+')) >= 50")
    labelled = docs.join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality"), "doc_id")
    menus = spark.createDataFrame([(-1, " | ".join(f"item{i}" for i in range(200)), 0)], "doc_id long, text string, quality int")
    labelled = labelled.select("doc_id", "text", "quality").unionByName(menus)
    kept = corpus_pipeline.quality_rules(spark, labelled, folder).groupBy("quality").count()
    total = {r["quality"]: r["count"] for r in labelled.groupBy("quality").count().collect()}
    share = {r["quality"]: r["count"] / total[r["quality"]] for r in kept.collect()}
    assert share.get(0, 0) <= 0.01 and share[1] >= 0.99
