"""The operators bound to the driver's tables: one thin query each, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geopanel.llm import lm_score
from geopanel.llm.ann import nearest
from geopanel.llm.html_extract import extract
from geopanel.llm.lexical import TERM, search
from geopanel.llm.line_dedup import MIN_SITES, MIN_WORDS, drop_common_lines
from geopanel.llm.minhash import near_duplicates
from geopanel.llm.mixing import mix
from geopanel.llm.outliers import flag
from geopanel.llm.packing import pack
from geopanel.llm.quality import fit, score
from geopanel.llm.secrets import BASE, find_secrets, labelled_samples, span_text, train
from geopanel.llm.sharding import shard
from geopanel.llm.whitening import whiten

HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    vocab, net = lm_score.train(docs)
    return lm_score.score(docs, vocab, net).withColumnRenamed("id", "doc_id")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("id", "doc_id")


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    # Of the metadata, n_chars alone may be an input of a score.
    machine = fit(docs, _table(spark, sf_dir, "labels").where(~F.expr(HELD_OUT)), metadata=("n_chars",))
    out = score(docs, machine, keep=["doc_id"], metadata=("n_chars",))
    return out.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law"))
    out = shard(rows, ["doc_id"], [1.0] * 16)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op7_pattern_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


def op8_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_common_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "lines_removed", "words_removed")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), k=2).withColumnRenamed("id", "doc_id")


def op10_posting_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), k=10)


def op11_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = find_secrets(docs, train(labelled_samples(docs)))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind, *_ in BASE]
    slim = [F.transform(c, lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"])) for c in ("base", "added")]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.array_sort(F.concat(*slim))).alias("spans"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pseudo_likelihood": op1_pseudo_likelihood,
    "op2_source_mix": op2_source_mix,
    "op3_quality_fm": op3_quality_fm,
    "op4_rendezvous_shards": op4_rendezvous_shards,
    "op5_robust_outliers": op5_robust_outliers,
    "op6_page_text": op6_page_text,
    "op7_pattern_pack": op7_pattern_pack,
    "op8_line_spread": op8_line_spread,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_posting_search": op10_posting_search,
    "op11_block_search": op11_block_search,
    "op12_markov_secrets": op12_markov_secrets,
    "op13_whitening": op13_whitening,
}

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLE: dict[str, str] = {
    "op8_line_spread": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text, source FROM documents),
lines AS (
  SELECT r, doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM docs
), sized AS (
  SELECT *, len(regexp_extract_all(line, '{_WORD}')) AS w, regexp_replace(regexp_replace(line, '^{_SPACE}', ''), '{_SPACE}$', '') AS body FROM lines
), common AS (
  SELECT body FROM sized WHERE w >= {MIN_WORDS} GROUP BY body HAVING count(DISTINCT coalesce('s' || source, 'n')) >= {MIN_SITES}
), marked AS (
  SELECT s.*, (w >= {MIN_WORDS} AND c.body IS NOT NULL) AS hit FROM sized s LEFT JOIN common c ON s.body = c.body
), per AS (
  SELECT r, count(*) FILTER (hit) AS n, coalesce(sum(w) FILTER (hit), 0) AS gone, coalesce(sum(w), 0) AS words,
         string_agg(line, chr(10) ORDER BY i) FILTER (NOT hit) AS rest
  FROM marked GROUP BY r
)
SELECT doc_id,
       CASE WHEN n > 0 AND 4 * gone <= 3 * words THEN rest ELSE text END AS text,
       CAST(CASE WHEN n > 0 AND 4 * gone <= 3 * words THEN n ELSE 0 END AS BIGINT) AS lines_removed,
       CAST(CASE WHEN n > 0 AND 4 * gone <= 3 * words THEN gone ELSE 0 END AS BIGINT) AS words_removed
FROM docs LEFT JOIN per USING (r)
""",
    "op11_block_search": rf"""
WITH words AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{TERM}')) AS term
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)
), tf AS (SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY ALL), sizes AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sizes), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{TERM}')) AS term FROM benchmark),
scored AS (
  SELECT item_id, r, doc_id, sum(CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
  FROM items JOIN tf USING (term) JOIN df USING (term) JOIN sizes USING (r) CROSS JOIN whole GROUP BY item_id, r, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
""",
}
