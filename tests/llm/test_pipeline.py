"""The pipeline's stages on the smallest tables: each takes all that the one before kept."""

import corpus_pipeline
from accordant.llm import decontaminate, packing
from accordant.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] == sizes[4] > 0.5 * sizes[0]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    before = spark.read.parquet(str(tmp_path / "simhash_dedup"))
    hits = lambda d: decontaminate.digest(decontaminate.contamination(d, bench)).where("contaminated").count()
    assert hits(before) > 0 == hits(docs)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and packing.CAPACITY == 2048
