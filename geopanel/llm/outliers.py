"""Robust multivariate outliers among documents: minimum covariance determinant per language and source.

DataFrame functions only. Each document has a vector of transformed statistics. For every group, concentration steps
start from three deterministic estimates (medians with quartile spreads, the correlation of hyperbolic tangents, and that
of spatial signs): all vectors get their Mahalanobis distance under the current estimate, and the h nearest (three
quarters) give the next mean and covariance. After FIRST steps each group goes on with the start of the least determinant,
until no group's determinant falls any more. The nearest h are found without sorting: distances fall into fixed
logarithmic bins, one aggregation sums counts and moments a bin, a running count over at most BINS bins says which of them
make the subset, and the bin at the edge counts with the part that h needs. Vectors are never dealt by group: the table of
estimates goes to them, or those of the largest groups where there are many.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geopanel.llm.common import cut, group_key, meet, words

#: The share of a group that the estimate is made of.
INLIERS = 0.75
#: Steps of all starts; further steps at most, and the fall of a log determinant that ends them.
FIRST, STEPS, STILL = 2, 30, 1e-3
BINS = 400
#: Groups with fewer documents, too few for a covariance of seven statistics, use the estimate of all documents.
LEAST = 100
#: Added in square to the variance of each coordinate: within it a group is uniform, and deviation is measured in it.
FLOOR = {"size": 0.5, "word": 0.12, "symbol": 0.5, "line": 0.5, "repeat": 0.7, "shout": 0.4, "distinct": 0.25}
DIMS = list(FLOOR)
#: The group of all documents; keys of others begin with s or n.
_ALL = "all"


def chi2_cdf(x: float, p: int) -> float:
    """Distribution function of chi-square with p degrees of freedom, by its series."""
    a, z = p / 2, x / 2
    term = total = 1.0
    k = a
    while term > 1e-17 * total:
        k += 1
        term *= z / k
        total += term
    return total * math.exp(a * math.log(z) - z - math.lgamma(a + 1)) if z > 0 else 0.0


def chi2_quantile(q: float, p: int) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, p) < q else (lo, mid)
    return hi


#: Of a normal sample, the inner INLIERS have a covariance that is too small by this factor.
CONSISTENT = INLIERS / chi2_cdf(chi2_quantile(INLIERS, len(DIMS)), len(DIMS) + 2)
#: Squared distance beyond which a document is rejected: that which one in a million normal vectors exceeds.
CUT = chi2_quantile(1 - 1e-6, len(DIMS))


def statistics(text: Column) -> dict[str, Column]:
    """Expressions over columns __t (text, '' for null) and __w (its words)."""
    t, w = F.col("__t"), F.col("__w")
    lines = F.filter(F.split(t, "\n", -1), lambda v: v.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.transform(w, lambda v: F.xxhash64(v))
    return {"n_words": F.size(w).cast("long"), "word_chars": F.length(F.array_join(w, "")).cast("long"), "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"), "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"), "n_shouts": F.length(F.regexp_replace(t, r"[^A-Z!]+", "")).cast("long"), "n_distinct": F.size(F.array_distinct(w)).cast("long"), "__h": hashes}


def repeat_words(hashes: Column, n: int = 8) -> Column:
    """Words inside n-word windows that occur twice or more, the first occurrence included; hashes: a hash a word."""

    def window_hash(h: Column, i: Column) -> Column:
        return F.xxhash64(*[F.get(h, i + k) for k in range(n)])

    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: window_hash(hashes, i))

    def starts(by_hash: Column) -> Column:
        """Start positions of windows whose hash is that of a neighbour in hash order."""
        last = F.size(by_hash) - 1

        def again(x: Column, j: Column) -> Column:
            before = (j > 0) & (F.get(by_hash, j - 1)["h"] == x["h"])
            after = (j < last) & (F.get(by_hash, j + 1)["h"] == x["h"])
            return F.when(before | after, x["i"])

        return F.array_sort(F.filter(F.transform(by_hash, again), lambda v: v.isNotNull()))

    def covered(at: Column) -> Column:
        """Words under windows that start at the sorted positions."""
        gaps = F.transform(at, lambda p, k: F.least(F.lit(n), F.coalesce(F.get(at, k + 1) - p, F.lit(n))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def let(value: Column, body) -> Column:
        """body(value) with value evaluated once."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def count(ws: Column) -> Column:
        ordered = F.sort_array(F.transform(ws, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        dup = let(ordered, lambda o: let(starts(o), covered))
        return F.when(F.size(F.array_distinct(ws)) == F.size(ws), F.lit(0)).otherwise(dup)

    return F.when(F.size(hashes) <= n, F.lit(0)).otherwise(let(windows, count)).cast("long")


def base_statistics(docs: DataFrame, id_col: str, text_col: str, group_cols: list[str]) -> DataFrame:
    """id, group columns, n_words, word_chars, n_symbols, n_dup_lines, n_shouts, n_distinct and n_repeat_words of every
    whole text."""
    d = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"g{k}") for k, c in enumerate(group_cols)], F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    d = d.withColumn("__w", words(F.col("__t")))
    stats = statistics(F.col("__t"))
    d = d.select("id", *[f"g{k}" for k in range(len(group_cols))], *[c.alias(n) for n, c in stats.items()])
    return d.withColumn("n_repeat_words", repeat_words(F.col("__h"))).drop("__h")


def vector() -> dict[str, Column]:
    """Transformed statistics of a document with a word: logarithms of size, mean word length, share of distinct words,
    and of symbols, repeated lines, repeated words and capitals with exclamation marks against the size."""
    n = F.col("n_words").cast("double")
    return {
        "size": F.ln(1 + n),
        "word": F.ln(F.col("word_chars") / F.greatest(n, F.lit(1.0))),
        "symbol": F.ln(1 + 100 * F.col("n_symbols") / F.greatest(n, F.lit(1.0))),
        "line": F.ln(1 + F.col("n_dup_lines")),
        "repeat": F.ln(1 + 100 * F.col("n_repeat_words") / F.greatest(n, F.lit(1.0))),
        "shout": F.ln(1 + 100 * F.col("n_shouts") / F.greatest(n, F.lit(1.0))),
        "distinct": F.ln(F.col("n_distinct") / F.greatest(n, F.lit(1.0))),
    }


def _distance(mean: list[Column], inv: dict[tuple[int, int], Column], x: list[Column]) -> Column:
    """Squared Mahalanobis distance: the squared length of (x - mean) under the inverse Cholesky factor."""
    z = [a - b for a, b in zip(x, mean, strict=True)]
    rows = [reduce(lambda a, b: a + b, [inv[i, j] * z[j] for j in range(i + 1)]) for i in range(len(x))]
    return reduce(lambda a, b: a + b, [F.pow(v, F.lit(2.0)) for v in rows])


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(DIMS)) for j in range(i + 1)]


def _factor(m: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, size_n, mean, inverse Cholesky factor (w00, w10, ..) and log determinant of estimates with mean columns m0..
    and covariance columns c00, c10, ..; every variance has its floor's square added, which keeps the factor regular."""
    d = len(DIMS)
    m = m.withColumns({f"c{i}{i}": F.greatest(F.col(f"c{i}{i}"), F.lit(0.0)) + FLOOR[name] ** 2 for i, name in enumerate(DIMS)})
    # Each step is a projection of its own over the table of estimates, so that expressions stay small.
    for j in range(d):
        v = reduce(lambda a, b: a - b, [F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.col(f"c{j}{j}"))
        m = m.withColumn(f"l{j}{j}", F.sqrt(F.greatest(v, F.lit(1e-9))))
        below = {f"l{i}{j}": reduce(lambda a, b: a - b, [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.col(f"c{i}{j}")) / F.col(f"l{j}{j}") for i in range(j + 1, d)}
        m = m.withColumns(below) if below else m
    m = m.withColumns({f"w{i}{i}": 1 / F.col(f"l{i}{i}") for i in range(d)})
    for gap in range(1, d):
        m = m.withColumns({f"w{i}{i - gap}": -reduce(lambda a, b: a + b, [F.col(f"l{i}{k}") * F.col(f"w{k}{i - gap}") for k in range(i - gap, i)]) / F.col(f"l{i}{i}") for i in range(gap, d)})
    det = reduce(lambda a, b: a + b, [2 * F.ln(f"l{i}{i}") for i in range(d)])
    return m.select(*keys, "size_n", *[f"m{i}" for i in range(d)], *[f"w{i}{j}" for i, j in _pairs()], det.alias("det"))


def _estimate(m: DataFrame, keys: list[str]) -> DataFrame:
    """Estimates from summed moments n, s0.., q00, .."""
    m = m.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(len(DIMS))})
    return _factor(m.withColumns({f"c{i}{j}": CONSISTENT * (F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) for i, j in _pairs()}), keys)


def _moments() -> dict[str, Column]:
    """Sums of the coordinates and of their products, and the number of rows."""
    x = [F.col(n) for n in DIMS]
    return {"n": F.count("*"), **{f"s{i}": F.sum(x[i]) for i in range(len(DIMS))}, **{f"q{i}{j}": F.sum(x[i] * x[j]) for i, j in _pairs()}}


def _with_distance(vectors: DataFrame, est: DataFrame, groups: int) -> DataFrame:
    d = len(DIMS)
    inv = {(i, j): F.col(f"w{i}{j}") for i, j in _pairs()}
    both = meet(vectors, est, "grp", groups, "size_n")
    return both.withColumn("distance", _distance([F.col(f"m{i}") for i in range(d)], inv, [F.col(n) for n in DIMS]))


def _starts(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(the three starting estimates of every grp, number of groups)."""
    d = len(DIMS)
    p = vectors.groupBy("grp").agg(F.count("*").alias("size_n"), *[F.percentile_approx(n, [0.25, 0.5, 0.75], 2000).alias(n) for n in DIMS])
    mid = [F.get(F.col(n), F.lit(1)).alias(f"m{i}") for i, n in enumerate(DIMS)]
    spread = [F.greatest((F.get(F.col(n), F.lit(2)) - F.get(F.col(n), F.lit(0))) / 1.349, F.lit(FLOOR[n])).alias(f"r{i}") for i, n in enumerate(DIMS)]
    p = cut(p.select("grp", "size_n", *mid, *spread))
    groups = p.count()
    z = meet(vectors, p, "grp", groups, "size_n").select("grp", *[((F.col(n) - F.col(f"m{i}")) / F.col(f"r{i}")).alias(f"z{i}") for i, n in enumerate(DIMS)])
    far = F.greatest(reduce(lambda a, b: a + b, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(d)]), F.lit(1e-12))
    tanh = {f"t{i}{j}": F.avg(F.tanh(f"z{i}") * F.tanh(f"z{j}")) for i, j in _pairs()}
    sign = {f"u{i}{j}": F.avg(d * F.col(f"z{i}") * F.col(f"z{j}") / F.col("far")) for i, j in _pairs()}
    both = p.join(z.withColumn("far", far).groupBy("grp").agg(*[c.alias(n) for n, c in {**tanh, **sign}.items()]), "grp")
    scale = {(i, j): F.col(f"r{i}") * F.col(f"r{j}") for i, j in _pairs()}
    base = ["grp", "size_n", *[f"m{i}" for i in range(d)]]
    out = [
        both.select(*base, F.lit(k).alias("start"), *[(scale[i, j] * c(i, j)).alias(f"c{i}{j}") for i, j in _pairs()])
        for k, c in enumerate((lambda i, j: F.lit(float(i == j)), lambda i, j: F.col(f"t{i}{j}"), lambda i, j: F.col(f"u{i}{j}")))
    ]
    return cut(_factor(reduce(DataFrame.unionAll, out), ["grp", "start"])), groups


def _step(vectors: DataFrame, est: DataFrame, groups: int) -> DataFrame:
    """The estimates from the h vectors of every group that are nearest under est."""
    # 1/20 of a factor of e a bin; distances under e^-10 share the first bin.
    b = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(20 * (F.ln(F.col("distance") + 1e-12) + 10)).cast("int")))
    part = _with_distance(vectors, est, groups).groupBy("grp", "start", b.alias("bin")).agg(*[c.alias(n) for n, c in _moments().items()])
    w = Window.partitionBy("grp", "start")
    part = part.withColumn("before", F.sum("n").over(w.orderBy("bin")) - F.col("n")).withColumn("size_n", F.sum("n").over(w))
    part = part.where(F.col("before") < INLIERS * F.col("size_n"))
    part = part.withColumn("part", F.least(F.lit(1.0), (INLIERS * F.col("size_n") - F.col("before")) / F.col("n")))
    inner = part.groupBy("grp", "start").agg(F.first("size_n").alias("size_n"), *[F.sum(F.col("part") * F.col(n)).alias(n) for n in _moments()])
    return cut(_estimate(inner, ["grp", "start"]))


def mcd(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(grp, size_n, mean and inverse Cholesky factor of its minimum-covariance-determinant estimate, and their number)."""
    est, groups = _starts(vectors)
    for _ in range(FIRST):
        est = _step(vectors, est, groups)
    w = Window.partitionBy("grp").orderBy("det", "start")
    est = cut(est.withColumn("best", F.row_number().over(w)).where("best = 1").drop("best"))
    for _ in range(STEPS):
        new = _step(vectors, est, groups)
        fall = est.select("grp", F.col("det").alias("old")).join(new.select("grp", "det"), "grp").agg(F.max(F.col("old") - F.col("det"))).first()[0]
        est = new
        if fall is None or fall < STILL:
            break
    return est.drop("start", "det"), groups


def flag(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source"), cut_at: float = CUT) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept for every row.

    base_failed: fewer than 20 words, or over 30% of the words in repeated 8-word windows. Estimates are made of the
    documents that pass; kept is true for those of them whose squared distance is at most cut_at. Groups with fewer than
    LEAST such documents are measured by the estimate of all of them. Null texts have no words; null group values are a
    group of their own; repeated rows count each; an empty table gives an empty result; other columns are ignored.
    """
    stats = base_statistics(docs, id_col, text_col, list(group_cols))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    group = F.concat_ws("\x00", *[group_key(F.col(f"g{k}")) for k in range(len(group_cols))])
    stats = cut(stats.select("id", group.alias("grp"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_shouts", "n_distinct", "n_repeat_words", failed.alias("base_failed")))
    good = stats.where(~F.col("base_failed")).select(F.explode(F.array("grp", F.lit(_ALL))).alias("grp"), *[c.alias(n) for n, c in vector().items()])
    est, groups = mcd(good)
    own = est.where((F.col("size_n") >= LEAST) & (F.col("grp") != _ALL))
    every = est.where(F.col("grp") == _ALL).drop("grp", "size_n")
    d = len(DIMS)
    names = [f"m{i}" for i in range(d)] + [f"w{i}{j}" for i, j in _pairs()]
    every = every.select(*[F.col(c).alias("e" + c) for c in names])
    x = list(vector().values())
    out = meet(stats, own, "grp", groups, "size_n", "left").join(F.broadcast(every), how="left")  # one row
    at = {c: F.coalesce(F.col(c), F.col("e" + c)) for c in names}
    dist = _distance([at[f"m{i}"] for i in range(d)], {(i, j): at[f"w{i}{j}"] for i in range(d) for j in range(i + 1)}, x)
    out = out.withColumn("distance", F.when(~F.col("base_failed"), dist))
    kept = F.coalesce(~F.col("base_failed") & (F.col("distance") <= cut_at), F.lit(False))
    return out.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))
