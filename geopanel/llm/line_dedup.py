"""Cross-site boilerplate removal by the spread of each line over distinct sites. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopanel.llm.common import SPACE, cut, group_key, n_words, own_prefix, trimmed

MIN_SITES = 10
MIN_WORDS = 4
#: Documents of which boilerplate would take over 3/4 of the words are copies rather than framed pages.
MAX_SHARE = (3, 4)


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def common_lines(lines: DataFrame, min_sites: int, lg_k: int = 12) -> DataFrame:
    """(h1, h2) of the lines on at least min_sites distinct sites; lines has h1, h2, site.

    One HyperLogLog sketch a line hash, merged by the aggregation. Its relative error is 1.04 / sqrt(2^lg_k), 1.6% at 12:
    estimates within 25% of the threshold (and never less than 2 sites from it) are counted exactly.
    """
    near = max(2.0, 0.25 * min_sites)
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.count("*").alias("n"))
    spread = spread.where(F.col("n") >= min_sites).select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = cut(spread.where(F.col("sites") >= min_sites - near))
    close = spread.where(F.col("sites") <= min_sites + near).select("h1", "h2")
    exact = lines.join(close, ["h1", "h2"], "left_semi").distinct().groupBy("h1", "h2").count()
    return spread.where(F.col("sites") > min_sites + near).select("h1", "h2").unionAll(exact.where(F.col("count") >= min_sites).select("h1", "h2"))


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, max_share: tuple[int, int] = MAX_SHARE) -> DataFrame:
    """docs with boilerplate lines taken out of the text, and columns lines_removed and words_removed (long) added.

    A line, trimmed of ASCII white space, is boilerplate if it has min_words words or more and stands in documents of
    min_sites sites or more (null is a site of its own). Its occurrences go, with their line break, from every document
    except those of which boilerplate is more than max_share of the words: they are copies of one another, which
    removal would empty, and are left whole for document deduplication. Null texts stay null, blank texts stay as they
    are, repeated rows are all cleaned alike, an empty table gives an empty result, and other columns pass through.
    """
    names = docs.columns
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    base = docs.select(key.alias("k"), group_key(F.col(site_col)).alias("site"), F.posexplode(_lines(F.col(text_col))).alias("i", "line"))
    base = base.select("k", "site", "i", trimmed(F.col("line")).alias("line"))
    base = base.withColumn("w", F.size(F.split("line", SPACE))).where((F.col("w") >= min_words) & (F.col("line") != ""))
    # The lines' hashes are written once, a small part of the text, and read by the sketches, the counts and the removal.
    base = cut(base.select("k", "site", "i", "w", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), F.col("line")).alias("h2")))
    common = cut(common_lines(base.select("h1", "h2", "site"), min_sites))
    gone = base.select("k", "i", "w", "h1", "h2").join(common, ["h1", "h2"], "left_semi")
    gone = gone.select("k", "i", "w").distinct().groupBy("k").agg(F.collect_list("i").alias("at"), F.sum("w").alias("words"))
    p = own_prefix(names)
    mine, theirs, at, words, take = (p + c for c in ("key", "k", "at", "words", "take"))
    gone = gone.select(F.col("k").alias(theirs), F.col("at").alias(at), F.col("words").alias(words))
    out = docs.withColumn(mine, key).join(gone, F.col(mine) == F.col(theirs), "left")
    some = F.col(words).isNotNull() & (max_share[1] * F.coalesce(words, F.lit(0)) <= max_share[0] * n_words(F.col(text_col)))
    lines = _lines(F.col(text_col))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(at))
    kept = F.array_join(F.transform(left, lambda j: F.get(lines, j)), "\n")
    out = out.withColumn(take, some)
    new = F.when(F.col(take), kept).otherwise(F.col(text_col))
    cols = [new.alias(c) if c == text_col else F.col(f"`{c}`") for c in names if c.lower() not in ("lines_removed", "words_removed")]
    return out.select(*cols, F.when(F.col(take), F.size(at)).otherwise(0).cast("long").alias("lines_removed"), F.when(F.col(take), F.col(words)).otherwise(0).cast("long").alias("words_removed"))
