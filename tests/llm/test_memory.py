import random
import subprocess
import sys
from pathlib import Path

import pytest

from geopanel.llm import common, minhash, packing, quality
from geopanel.llm.common import cut
from geopanel.llm.minhash import components

FREED = """
import re
from geopanel.llm.common import lean

def mb():
    return sum(map(int, re.findall(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read()))) / 1024

def run(batches):
    kept = [bytes(50_000) for _ in range(4_000)]
    for b in batches:
        yield b
    keep.append(kept[-1])  # what is freed below it stays with the allocator

keep, before = [], mb()
for _ in lean(run)(iter([1])):
    most = mb()
print(before, most, mb())
"""


def test_a_task_gives_its_memory_back():
    out = subprocess.run([sys.executable, "-c", FREED], capture_output=True, text=True, check=True, cwd=Path(__file__).resolve().parents[2])
    before, most, after = map(float, out.stdout.split())
    assert most > before + 150
    assert after < before + 50


def test_memory_is_given_back_after_a_failure_too(monkeypatch):
    seen = []
    monkeypatch.setattr(common, "give_back", lambda: seen.append(1))

    def fails(batches):
        yield from batches
        raise ValueError

    with pytest.raises(ValueError):
        list(common.lean(fails)(iter([1])))
    assert seen == [1]


def test_blocks_of_text_are_small():
    # Array passes over a block take up to 60 bytes a byte of text.
    assert max(minhash.BLOCK_BYTES, quality.BLOCK_BYTES, packing.TOGETHER) <= 1 << 20


def test_small_work_tables_are_few_files(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]
    up = list(range(400))
    for a, b in edges:
        a, b = up[a], up[b]
        up = [min(a, b) if x in (a, b) else x for x in up]
    want = {i: c for i, c in enumerate(up) if i != c}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        nodes = spark.range(400).withColumnRenamed("id", "node")
        out = components(nodes, cut(spark.createDataFrame(edges, "a long, b long")))
        assert {r.id: r.component for r in out.collect()} == want
        assert out.rdd.getNumPartitions() == 1  # 37 before
        assert cut(spark.range(0, 50_000, 1, 8), 50_000).rdd.getNumPartitions() == 3
        assert cut(spark.range(0, 50_000, 1, 8)).rdd.getNumPartitions() == 8
        assert cut(spark.range(0, 10, 1, 2), 10**9).rdd.getNumPartitions() == 2
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_tables_of_the_driver_keep_their_types(spark):
    rows = [("a", 1, 2.5, [3, 4]), ("ü", 2**60, 0.1, []), (None, 0, -1.0, None)]
    schema = "s string, n long, x double, v array<long>"
    out = common.local_table(spark, rows, schema)
    assert out.schema == spark.createDataFrame(rows, schema).schema
    assert [tuple(r) for r in out.collect()] == rows
    assert common.local_table(spark, [], schema).collect() == []
