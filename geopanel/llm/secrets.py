"""Secrets in texts: fixed patterns, and strings that character Markov models call random. DataFrame functions only.

Two first-order Markov chains over letters and digits, one of random strings and one of ordinary identifiers, are counted
from labelled samples by one aggregation. The other characters of a run join parts of it: the chains begin anew after them.
A run's log-likelihood ratio sums one entry of a table for each of its steps; the table, of STATES x STATES entries, is a constant of the plan. Texts are read where they are: nothing is shuffled
but the tokens of the training samples, counted before.

Positions come from splitting a text at the matches of a pattern: a match starts where the lengths of the parts and
matches before it end. Their running sums are taken in chunks, so that work stays near the number of matches.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (kind, pattern, group whose length counts, least length) by rank. Access and hex matches are whole runs, so their least
#: length may stand in the pattern; that of assign may not, since a short match takes its characters from later ones.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
#: Runs that the models judge have LEAST characters of this alphabet; those that they learn from have LEARN or more.
ALPHABET, JOINTS = r"[A-Za-z0-9+/_=-]", "+/_=-"
LEAST, LEARN = 16, 4
#: Log-likelihood ratio from which a run is a secret: it outweighs prior odds of one in a million.
THRESHOLD = math.log(1e6)
#: Added to each count of a step, and the states of the table: ASCII codes, 0 before the first character of a part.
PRIOR, STATES = 0.5, 128
#: The table holds the ratio in millionths, so that sums are exact.
UNIT = 1_000_000
CHUNK = 128


def running(lengths: str) -> Column:
    """The sum of the entries before each one of an array column: sums before each chunk, and those within it."""
    a, n = F.col(lengths), F.size(lengths)

    def total(start: Column, size: Column) -> Column:
        return F.aggregate(F.slice(a, start, size), F.lit(0), lambda s, v: s + v)

    def chunk(i: Column) -> Column:
        within = F.transform(F.sequence(F.lit(1), F.least(F.lit(CHUNK), n - i * CHUNK)), lambda j: total(i * CHUNK + 1, j - 1))
        return F.struct(total(F.lit(1), i * CHUNK).alias("before"), within.alias("within"))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), chunk)
    sums = F.flatten(F.transform(chunks, lambda c: F.transform(c["within"], lambda v: v + c["before"])))
    return F.when(n > 0, sums).otherwise(F.array().cast("array<int>"))


def located(df: DataFrame, text: str, pattern: str, group: int = 0) -> DataFrame:
    """df with parts (the text around the matches of the pattern), found (the matches, leftmost and apart), taken (their
    group) and starts (their first code points)."""
    t, hit = F.col(text), F.col(text).rlike(pattern)
    none = F.array().cast("array<string>")
    df = df.withColumns(
        {
            "parts": F.when(hit, F.split(t, pattern, -1)).otherwise(F.array(t)),
            "found": F.when(hit, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none),
            "taken": F.when(hit, F.regexp_extract_all(t, F.lit(pattern), F.lit(group))).otherwise(none),
        }
    )
    before = F.slice("parts", 1, F.size("found"))
    df = df.withColumn("lengths", F.zip_with(before, "found", lambda p, m: F.length(p) + F.length(m)))
    starts = F.zip_with(running("lengths"), before, lambda s, p: s + F.length(p))
    return df.withColumn("starts", starts).drop("lengths")


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, whose text is not null, with base (array of start, rank, kind, end, value by start, then rank) and rest: the
    text with every assign match that counts blanked, of the same length."""
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        docs = located(docs, text, pattern, group)
        hits = F.filter(F.arrays_zip("starts", "found", "taken"), lambda m: F.length(m["taken"]) >= least)
        spans = F.transform(hits, lambda m: F.struct(m["starts"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (m["starts"] + F.length(m["found"])).alias("end"), m["taken"].alias("value")))
        docs = docs.withColumn(kind, spans)
        if kind == "assign":
            blank = F.transform(F.arrays_zip("found", "taken"), lambda m: F.when(F.length(m["taken"]) >= least, F.repeat(F.lit(" "), F.length(m["found"]))).otherwise(m["found"]))
            docs = docs.withColumn("rest", F.array_join(F.zip_with("parts", F.concat(blank, F.array(F.lit(""))), lambda p, m: F.concat(p, m)), ""))
        docs = docs.drop("parts", "found", "taken", "starts")
    kinds = [k for k, *_ in BASE]
    return docs.withColumn("base", F.array_sort(F.concat(*kinds))).drop(*kinds)


def labelled_samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(label, token, weight) of a corpus: label 1, random, are the values of its base matches and, for each text, a digest
    of its hash in one of four encodings (base64, its letters and digits alone, in capitals, in small letters); label 0,
    ordinary, are its other runs of LEARN characters or more, counted, each as it is, in capitals and as a camel case pair."""
    rows = base_spans(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    key = F.xxhash64("text")
    digest = F.base64(F.unhex(F.sha2(key.cast("string"), 256)))
    plain = F.regexp_replace(digest, f"[{JOINTS}]+", "")
    code = F.pmod(key, F.lit(4))
    digest = F.when(code == 0, digest).when(code == 1, plain).when(code == 2, F.upper(plain)).otherwise(F.lower(plain))
    random = F.concat(F.transform("base", lambda s: s["value"]), F.array(digest))
    # One pass over the texts for both classes: the label goes with the array.
    runs = F.regexp_extract_all("rest", F.lit(ALPHABET + f"{{{LEARN},}}"), F.lit(0))
    rows = rows.select(F.explode(F.array(F.struct(F.lit(1).alias("label"), random.alias("tokens")), F.struct(F.lit(0).alias("label"), runs.alias("tokens")))).alias("s"))
    rows = rows.select("s.label", F.explode("s.tokens").alias("token")).groupBy("label", "token").agg(F.count("*").alias("weight"))
    rows = rows.where((F.col("label") == 1) | ~_held(F.col("token")))
    cased = F.array("token", F.upper("token"), F.concat(F.initcap("token"), F.initcap("token")))
    return rows.select("label", F.explode(F.when(F.col("label") == 1, F.array("token")).otherwise(cased)).alias("token"), "weight")


def _held(run: Column) -> Column:
    """Whether a run holds an access or hex match that counts."""
    return run.rlike(r"AKIA[A-Z0-9]{14}|[0-9a-f]{16}")


def _worded(run: Column) -> Column:
    """A run without its parts of digits alone: numbers, dates and versions speak for neither class."""
    return F.regexp_replace(run, r"(?<![A-Za-z0-9])[0-9]+(?![A-Za-z0-9])", "")


def train(samples: DataFrame) -> list[int]:
    """The table of log-likelihood ratios of steps, in millionths, from (label, token, weight): 1 random, 0 ordinary.

    Every sample counts, part by part, but for parts of digits alone; tokens outside the alphabet and null ones do not.
    Where a class has no sample, all entries are 0. The driver gets one row a class and step, at most twice the square of
    the alphabet.
    """
    tokens = samples.where(F.col("token").rlike(f"^{ALPHABET}+$") & F.col("label").isin(0, 1))
    tokens = tokens.select("label", "weight", F.explode(F.split(_worded(F.col("token")), f"[{JOINTS}]+")).alias("part")).where("part <> ''")
    codes = F.transform(F.split("part", ""), lambda c: F.ascii(c))
    tokens = tokens.select("label", "weight", codes.alias("codes"))
    steps = F.zip_with(F.concat(F.array(F.lit(0)), F.slice("codes", 1, F.size("codes") - 1)), "codes", lambda a, b: a * STATES + b)
    counts = tokens.select("label", "weight", F.explode(steps).alias("step")).groupBy("label", "step").agg(F.sum("weight").alias("n"))
    seen = np.zeros((2, STATES, STATES))
    for r in counts.collect():
        seen[r.label, r.step // STATES, r.step % STATES] = r.n
    if not seen.any(axis=(1, 2)).all():
        return [0] * (STATES * STATES)
    known = np.array([chr(c).isascii() and chr(c).isalnum() for c in range(STATES)])
    p = (seen + PRIOR) / (seen.sum(2, keepdims=True) + PRIOR * known.sum())
    ratio = np.where(known[None, :], np.log(p[1] / p[0]), 0.0)
    return np.rint(ratio * UNIT).astype(int).ravel().tolist()


def ratio(token: Column, table: list[int]) -> Column:
    """The log-likelihood ratio of a token, in millionths."""
    entries = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")  # a constant once optimised
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("sum"))

    def step(state: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.struct(F.when(c.isin(*JOINTS), 0).otherwise(code).alias("at"), (state["sum"] + F.get(entries, state["at"] * STATES + code)).alias("sum"))

    return F.aggregate(F.split(_worded(token), ""), start, step, lambda s: s["sum"])


def find_secrets(docs: DataFrame, table: list[int], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, base, added): the spans of base matches (start, rank, kind, end, value) and those that the models add, of kind
    markov, whose value has a log-likelihood ratio of the threshold or more (start, rank, kind, end, value, ratio).

    Positions count code points, ends are exclusive, and whole matches are spans; of an assign match the value is its
    second group. Matches are leftmost and apart within a kind, and those too short are dropped after matching. The models
    judge runs of LEAST characters or more outside assign matches that hold no access or hex match. Null and blank texts
    have no spans; whole texts are read, however long (their work grows with the number of matches, and slowly with its
    square: a 256th of it counts). Repeated rows give equal rows, the id passes through with its type, and further
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = base_spans(rows).drop("text")
    rows = located(rows, "rest", ALPHABET + f"{{{LEAST},}}")
    runs = F.filter(F.arrays_zip("starts", "found"), lambda m: ~_held(m["found"]))
    scored = F.transform(runs, lambda m: F.struct(m["starts"].alias("start"), F.lit(len(BASE)).alias("rank"), F.lit("markov").alias("kind"), (m["starts"] + F.length(m["found"])).alias("end"), m["found"].alias("value"), ratio(m["found"], table).alias("ratio")))
    added = F.filter(scored, lambda s: s["ratio"] >= int(threshold * UNIT))
    return rows.select("id", "base", added.alias("added"))


def span_text(spans: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
