from pyspark.sql import functions as F

import corpus_pipeline
from shelfspark.llm import quality_rules


def test_stages_take_effect_and_keep_the_columns(spark, tmp_path):
    good = [f"clean{i} text{i * 7} about{i * 3} some{i * 11} thing{i} that{i * 5} nobody{i} wrote{i * 2} twice{i} at{i * 13} all{i} here{i * 17}" for i in range(60)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(good)]
    rows += [(100 + i, good[i], "en", "s", 1) for i in range(5)]
    rows += [(200 + i, f"JUNK{i}*** WORD{i}&&& " * 12, "en", "s", 0) for i in range(60)]
    rows += [(300, "few words", "en", "s", 1), (301, None, "en", "s", 0)]
    d = f"file://{tmp_path}"
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, q int")
    docs = df.drop("q").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{d}/documents.parquet")
    df.selectExpr("doc_id", "q as quality", "0 as toxic").write.parquet(f"{d}/labels.parquet")
    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, d)
        now.write.parquet(f"{d}/{name.replace(' ', '_')}")
        now = spark.read.parquet(f"{d}/{name.replace(' ', '_')}")
        kept[name] = {r["doc_id"] for r in now.select("doc_id").collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
    assert set(range(60)) <= kept["quality classifier"] and not kept["quality classifier"] & set(range(200, 260))
    assert 300 not in kept["quality rules"] and set(range(60)) <= kept["quality rules"]
    assert set(range(60)) <= kept["MinHash near-dedup"] and len(kept["MinHash near-dedup"] & set(range(100, 105))) <= 1
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, d).select("doc_id").collect()} == kept["best-fit packing"]
    assert quality_rules.MIN_WORDS == 10
