"""The pipeline end to end, against its stages run one by one."""


import corpus_pipeline
from recordweave.llm import quality

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "pack"]
    now, sizes = docs, [docs.count()]
    for name, step in corpus_pipeline.STAGES:
        now = corpus_pipeline.stage(step(spark, now, FOLDER), "t_" + name)
        sizes.append(now.count())
        if name != "pack":
            assert now.columns == docs.columns, name
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] >= sizes[4] > 0
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    bad = {r.doc_id for r in quality.quality(docs, labels).collect() if not r.predicted}
    ran = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(tuple, ran.drop("sequence_id", "offset").collect())) == sorted(map(tuple, now.drop("sequence_id", "offset").collect()))
    assert not {r.doc_id for r in ran.collect()} & bad
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_keep_columns_of_any_name(spark):
    from recordweave.llm import leaks, quality

    docs = spark.createDataFrame([(i, f"some words of text number {i} stand here", 1.0, "m", 2) for i in range(30)],
                                 "doc_id bigint, text string, _score double, _mark string, _id int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id bigint, quality bigint, toxic bigint")
    items = spark.createDataFrame([(1, "some words of text number 3 stand here")], "item_id bigint, text string")
    assert quality.keep_good(docs, labels).columns == docs.columns
    out = leaks.drop_leaks(docs, items)
    assert out.columns == docs.columns and {r._mark for r in out.collect()} <= {"m"}
