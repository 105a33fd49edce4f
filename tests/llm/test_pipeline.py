from collections import Counter

import corpus_pipeline as cp
from geopanel.llm.minhash import near_duplicates
from geopanel.llm.quality import fit, score

DATA = "/root/testdata/sf0.001"


def test_stages_agree_with_their_operators(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs]
    for name, stage in cp.STAGES:
        out = stage(spark, seen[-1], DATA)
        out.write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    for d in seen[1:-1]:
        assert d.columns == cp.COLUMNS
    raw, good, lines, near, mixed, packed = seen
    m = fit(raw, cp._training_fold(spark.read.parquet(f"{DATA}/labels.parquet")))
    scores = {r.doc_id: r.score for r in score(raw, m).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, s in scores.items() if s >= cp.KEEP_FROM}
    assert lines.count() == good.count()
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    kept = {r.id for r in near_duplicates(lines).where("kept").collect()}
    assert Counter(r.doc_id for r in near.collect()) == Counter(kept)
    have = {r.doc_id: len(r.text.split()) for r in near.collect()}
    words = sum(len(r.text.split()) for r in mixed.collect())
    assert abs(words - 1.5 * sum(have.values())) < 0.03 * words
    assert set(r.doc_id for r in mixed.collect()) <= set(have)
    copies = Counter(r.doc_id for r in mixed.collect())
    first = Counter(r.doc_id for r in packed.where("piece = 0").collect())
    assert first == copies
    total = sum(r.length for r in packed.collect())
    assert len({r.sequence_id for r in packed.collect()}) <= total / 2048 * 1.02 + 1


def test_near_stage_keeps_one_of_repeated_rows(spark):
    text = "a document of quite a few words that stands here more than once"
    rows = [(1, text, "en", "s", 9), (1, text, "en", "s", 9), (2, text + " again", "en", "s", 9), (3, None, "en", None, None), (None, "lost id", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.near_stage(spark, docs, DATA)
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == ["1", "3", "None"]
