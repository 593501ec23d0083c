"""The pipeline's stages on a small table, each against what its operator says."""

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(2)
    words = ["".join(rng.choice("aeioubdlmnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    text = lambda n: (" ".join(rng.choice(words) for _ in range(n))).capitalize() + "."
    item = text(40)
    texts = [text(rng.randint(40, 120)) for _ in range(200)]
    texts += [" ".join(w.upper() + "!!" for w in text(60).split()) for _ in range(30)]
    texts += [texts[0], texts[1] + " end", text(30) + " " + item, text(40) + " token = abcdefghijklmnop99"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in range(230)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stage(stage(spark, docs, folder), name)
        assert out.columns == docs.columns
        kept[name], docs = {r[0] for r in out.select("doc_id").collect()}, out
    first = kept["quality_classifier"]
    assert len(first & set(range(200))) >= 195 and len(first & set(range(200, 230))) <= 3
    assert {230, 231} & kept["near_duplicate_join"] == set() and {0, 1} <= kept["near_duplicate_join"]
    assert kept["near_duplicate_join"] - kept["benchmark_decontamination"] == {232}
    assert kept["secret_scan"] == kept["benchmark_decontamination"]
    assert docs.filter(F.col("text").contains("[SECRET]")).select("doc_id").first()[0] == 233
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == kept["secret_scan"]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() >= 200
