import zlib

import numpy as np
from pyspark.sql import functions as F

from geopanel.llm import quality
from geopanel.llm.queries import op3_quality_fm

DATA = "/root/testdata/sf0.1"


def test_held_out_documents_of_the_query(spark):
    got = {r.doc_id: r for r in op3_quality_fm(spark, DATA).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert set(got) == set(docs)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality is not null").collect()}
    held = [i for i in labels if got[i].held_out]
    assert len(held) > 400
    right = np.mean([got[i].predicted == labels[i] for i in held])
    base = max(np.mean([labels[i] for i in held]), 1 - np.mean([labels[i] for i in held]))
    assert right > 0.98 and right > base + 0.1
    good, bad = ([got[i].score for i in held if labels[i] == y] for y in (1, 0))
    assert np.mean(np.subtract.outer(good, bad) > 0) > 0.99


def test_rows_of_the_fit_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda bounds, slot, value, label, **k: seen.append(len(bounds) - 1) or quality.Machine(0.0, np.zeros(1), np.zeros((1, 1))))
    same = spark.range(5000).selectExpr("1 doc_id", "'one text' text")
    texts = spark.range(3000).selectExpr("2 doc_id", "concat('text ', id) text")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    quality.fit(same, labels, max_labelled=50)
    quality.fit(same.unionAll(texts), labels, max_labelled=50)
    quality.fit(texts.limit(0), labels)
    assert seen == [1, 50, 0]


def test_metadata_is_an_input(spark):
    df = spark.range(600).selectExpr("id doc_id", "'the same words for all' text", "if(id % 2 = 0, 5, 90000) n_chars")
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    m = quality.fit(df, labels.where("doc_id < 400"), metadata=("n_chars",))
    got = quality.score(df.withColumn("score", F.lit("clash")), m, metadata=("n_chars",)).where("doc_id >= 400").collect()
    assert all((r.score > 0.5) == (r.n_chars > 5) for r in got)
    assert quality.score(df.withColumn("n_chars", F.lit(None).cast("int")), m, metadata=("n_chars",)).count() == 600
