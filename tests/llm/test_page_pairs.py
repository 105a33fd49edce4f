import random
import time
from os.path import commonprefix

from geopanel.llm import html_extract
from geopanel.llm.html_extract import common, extract, lines, main_text

SCHEMA = "page_id long, url string, html string"


def site(n=240, hosts=4):
    r = random.Random(2)
    rows = []
    for i in range(n):
        host = f"h{i % hosts if i % 3 else 0}.example"  # the first host is hot
        own = " ".join(r.choice(["river", "stone", "light", "green", "house"]) for _ in range(8)) + f" {i}"
        rows.append((i, f"http://{host}/p/{i:04d}", f"<body><div>Home of {host}</div><div>About us</div><div>{own}</div><div>Imprint {host}</div></body>", own))
    return rows


def texts(df):
    return sorted((str(r.id), r.text) for r in extract(df).collect())


def test_template_goes_however_pages_are_partitioned(spark):
    rows = site()
    df = spark.createDataFrame([r[:3] for r in rows], SCHEMA)
    want = sorted((str(i), own) for i, _, _, own in rows)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (2, 16, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert texts(df.repartition(n)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    # Without differencing every page keeps its frame.
    assert all(main_text(lines(page), None) != own for _, _, page, own in rows)


def test_pairs_against_brute_force(spark):
    rows = [r[:3] for r in site(60, 7)] + [(90, None, "<p>a</p><p>b</p>"), (91, None, "<p>a</p><p>c</p>"), (None, "http://h1.example/p", "<p>About us</p><p>z</p>"), (92, "http://alone.example/", "<div>one</div>")]
    rows += [rows[5], (5, rows[5][1], "<body><div>About us</div><div>other</div></body>")]
    df = spark.createDataFrame(rows, SCHEMA)
    marks = {(r.page_id, r.url, r.html): r.m for r in df.selectExpr("*", "xxhash64(html) m").collect()}
    keyed = sorted((("" if u is None else u.split("/")[2], "" if u is None else "/" + u.split("/", 3)[3], i is not None, i or 0, marks[i, u, h]), i, h) for i, u, h in rows)
    want = []
    for k, (key, i, h) in enumerate(keyed):
        # All pages of the host, the longest common head of the paths first, then the nearest in order.
        by = sorted((-len(commonprefix([key[1], other[0][1]])), abs(j - k), j, other[2]) for j, other in enumerate(keyed) if j != k and other[0][0] == key[0])
        near = [lines(h2) for _, away, _, h2 in by if away == 1]
        assert not by or by[0][1] == 1
        want.append((str(i), main_text(lines(h), *near)))
    assert texts(df) == sorted(want)


def test_long_pages(spark):
    at = time.time()
    same = ["x"] * 20_000
    assert len(common(same, ["y", *same[:-1], "z"])) == 19_999
    r = random.Random(3)
    a, b = ([r.choice("abcdef") for _ in range(20_000)] for _ in range(2))
    got = sorted(common(a, b))
    it = iter(b)
    assert len(got) > 10_000 and all(a[i] in it for i in got)
    assert [v.text for v in lines("<b>" * 20_000 + "deep")] == ["deep"] and len(lines("<div>x" * 20_000)) == 20_000
    assert time.time() - at < 30
    page = "".join(f"<div>line {i}</div>" for i in range(5000))
    df = spark.createDataFrame([(1, "http://a/1", page + "<div>own</div>"), (2, "http://a/2", "<div>mine</div>" + page.replace("line 7", "row 7"))], SCHEMA)
    got = dict(texts(df))
    assert "own" in got["1"] and "mine" in got["2"]


def test_cells_of_few_pages(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "SAMPLED", 1)
    rows = site(50, 3)
    assert texts(spark.createDataFrame([r[:3] for r in rows], SCHEMA)) == sorted((str(i), own) for i, _, _, own in rows)


def framed(section: str, own: str) -> str:
    return f"<body><div>Menu of {section}</div><div>{own}</div><div>Legal of {section}</div><div>Tail of {section}</div></body>"


def test_first_page_of_a_section_is_paired_within_it(spark):
    """A template a section: the page before /b/1 is of another section, the one after is nearer."""
    rows = [(i, f"http://x.example/{s}/{k}", framed(s, f"own text {i}")) for i, (s, k) in enumerate([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3)])]
    assert texts(spark.createDataFrame(rows, SCHEMA)) == [(str(i), f"own text {i}") for i in range(5)]


def test_beside_a_copy_the_other_neighbour_counts(spark):
    rows = [(0, "http://x.example/s/1", framed("s", "first")), (1, "http://x.example/s/20", framed("s", "same")), (2, "http://x.example/s/20", framed("s", "same")), (3, "http://x.example/s/3", framed("s", "last"))]
    assert texts(spark.createDataFrame(rows, SCHEMA)) == [("0", "first"), ("1", "same"), ("2", "same"), ("3", "last")]


def test_cells_follow_the_number_of_pages(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "CELL_PAGES", 4)
    rows = site(120, 3)
    assert texts(spark.createDataFrame([r[:3] for r in rows], SCHEMA)) == sorted((str(i), own) for i, _, _, own in rows)
