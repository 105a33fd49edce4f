import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from geopanel.streaming import online

DAY = 86_400_000
ARGS = (0.8, 1.0, 2.0, 0.0, 4.0)
SCHEMA = "user string, ts timestamp, v double"
START = dt.datetime(2024, 1, 1)


def source(spark, folder, batches):
    for k, part in enumerate(batches):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/{k}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def brute(rows, last, idle):
    """(site, day): x, p, n by a plain loop over days below last."""
    f, q, r, x0, p0 = ARGS
    want = {}
    for site in {a for a, _, _ in rows}:
        days = {}
        for a, t, v in rows:
            if a == site and t is not None:
                days.setdefault((t - START).days, []).append(v)
        fresh, x, p, empty = True, x0, p0, 0
        for d in range(last):
            if fresh and d not in days:
                x, p = f * x, f * f * p + q
                continue
            fresh = False
            x, p = f * x, f * f * p + q
            seen = [v for v in days.get(d, []) if v is not None]
            if seen:
                g = p / (p + r)
                x, p = x + g * (sum(seen) / len(seen) - x), (1 - g) * p
            want[site, d] = (x, p, len(seen))
            empty = 0 if d in days else empty + 1
            if empty >= idle:
                fresh, empty, x, p = True, 0, x0, p0
                for _ in range(d + 1):
                    x, p = f * x, f * f * p + q
    return want


def got(df):
    return {(r.site, (r.start - START).days): (r.x, r.p, r.n) for r in df.collect()}


def events():
    r = random.Random(5)
    rows = [(s, START + dt.timedelta(days=d, hours=r.randrange(24)), r.gauss(3, 2)) for s in ("a", "b", None) for d in range(12) for _ in range(3) if (s, d) not in {("b", 0), ("b", 4), ("b", 5), ("b", 6), ("a", 10)}]
    return rows + [("a", START + dt.timedelta(days=3, hours=1), None), ("c", START + dt.timedelta(days=2, hours=1), None), ("c", START + dt.timedelta(days=1), 2.0), ("a", None, 1.0), ("b", START + dt.timedelta(days=14), 0.0)]


@pytest.mark.parametrize("shuffled", [False, True])
@pytest.mark.parametrize("idle", [3, 100])
def test_levels_of_closed_steps_whatever_the_batches(spark, tmp_path, shuffled, idle):
    rows = events()
    if shuffled:
        random.Random(6).shuffle(rows)
        batches, late, closed = [rows[k::3] for k in range(3)], "20 days", 0
        # A last event moves the watermark past all that the batches hold.
        batches.append([("z", START + dt.timedelta(days=34), 0.0)])
        closed = 14
    else:
        early = [r for r in rows if r[1] is None or r[1] < START + dt.timedelta(days=6)]
        batches, late, closed = [early, [r for r in rows if r not in early]], "0 seconds", 14
    out = online.stream_levels(source(spark, tmp_path / "in", batches), "user", "ts", "v", *ARGS, late=late, origin_ms=int(START.replace(tzinfo=dt.timezone.utc).timestamp() * 1000), idle=idle)
    df = online.replayed(out)
    have, want = got(df), brute(rows, closed, idle)
    assert set(have) == set(want)
    assert all(have[k] == (pytest.approx(w[0]), pytest.approx(w[1]), w[2]) for k, w in want.items())


def test_late_rows_are_counted_and_change_nothing(spark, tmp_path):
    days = [("a", START + dt.timedelta(days=d, hours=2), float(d)) for d in range(6)]
    again = ("a", START + dt.timedelta(days=5, hours=11), 7.0)
    # The second batch closes days 0 to 4, so that of the third one two rows are late.
    batches = [days, [again], [("a", START + dt.timedelta(days=1), 99.0), ("a", START + dt.timedelta(days=2), 99.0), ("a", START + dt.timedelta(days=8), 1.0)]]
    src = source(spark, tmp_path / "in", batches)
    out = online.stream_levels(src, "user", "ts", "v", *ARGS, late="0 seconds", origin_ms=int(START.replace(tzinfo=dt.timezone.utc).timestamp() * 1000))
    spark.conf.set(*online.ROCKSDB)
    name = "late_" + uuid.uuid4().hex
    try:
        q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).outputMode("append").start()
        assert q.awaitTermination(120)
    finally:
        spark.conf.unset(online.ROCKSDB[0])
    assert online.late_rows(q) == 2
    have, want = got(spark.table(name)), brute([*days, again], 8, 366)
    assert set(have) == set(want) and all(have[k][0] == pytest.approx(want[k][0]) for k in want)


def test_empty_stream(spark, tmp_path):
    out = online.stream_levels(source(spark, tmp_path / "in", [[]]), "user", "ts", "v", *ARGS)
    assert online.replayed(out).count() == 0 and out.columns == ["site", "start", "x", "p", "loglik", "n"]
