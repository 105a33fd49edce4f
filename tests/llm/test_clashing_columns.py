from pyspark.sql import functions as F

from geopanel.llm.line_dedup import drop_common_lines
from geopanel.llm.mixing import mix
from geopanel.llm.sharding import shard


def test_columns_that_operators_use_themselves(spark):
    df = spark.range(40).selectExpr("id doc_id", "concat('a line of five words', char(10), 'own ', id) text", "concat('s', id % 20) source")
    odd = df.withColumns({c: F.lit("x") for c in ("__words", "__part", "___k", "__rid", "Shard", "Place", "LINES_REMOVED", "src", "key", "h1")})
    out = drop_common_lines(odd)
    assert out.columns.count("lines_removed") == 1 and "LINES_REMOVED" not in out.columns and "__words" in out.columns
    want = {r.doc_id: (r.text, r.lines_removed) for r in drop_common_lines(df).collect()}
    assert {r.doc_id: (r.text, r.lines_removed) for r in out.collect()} == want
    got = shard(odd, ["doc_id"], [1.0] * 4)
    assert "Shard" not in got.columns and "__part" in got.columns
    assert {r.doc_id: r.shard for r in got.collect()} == {r.doc_id: r.shard for r in shard(df, ["doc_id"], [1.0] * 4).collect()}
    mixed = mix(odd)
    assert "Shard" not in mixed.columns and "key" in mixed.columns
    a, b = (sorted((r.doc_id, r.copy, r.shard, r.place) for r in m.collect()) for m in (mixed, mix(df)))
    assert a == b
