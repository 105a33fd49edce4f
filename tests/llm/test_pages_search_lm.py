import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from geopanel.llm import lm_score
from geopanel.llm.ann import nearest
from geopanel.llm.html_extract import common, extract, lines, main_text

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<nav><ul><li><a href="/a">menu one</a></li></ul></nav><div class="top ad">buy now</div><header>site head</header>
<article><h1>A &amp; B</h1><p>First  <b>bold</b>
text<br>after<p>Second &lt;p&gt;<div class="comments">nice!</div><p>The same line.</p></article>
<aside>more</aside><form><p>mail</p></form><!-- gone --><footer>&copy; us</footer></body></html>"""


def test_an_article_without_its_frame():
    got = main_text(lines(PAGE), None)
    assert got == "A & B First bold text after Second <p> The same line."
    other = lines(PAGE.replace("First", "Other"))
    assert main_text(lines(PAGE), other) == got  # prose that two articles share stays


def test_shared_lines_go_where_nothing_declares_the_text():
    page = "<body><div>Home</div><div>About us</div><div>{}</div><div>{}</div><div>Imprint</div></body>"
    a, b = page.format("river stones", "more of a"), page.format("green hills", "more of b")
    assert main_text(lines(a), lines(b)) == "river stones more of a"
    assert main_text(lines(a), lines(a)).startswith("Home")  # copies say nothing of a template
    assert main_text(lines(a), None).startswith("Home")


def test_unclosed_and_cut_markup():
    assert main_text(lines("<nav><p>x<article><p>text &am"), None) == "text &am"
    assert main_text(lines('<article><p>one</p><a href="/x'), None) == "one"
    assert main_text(lines("<article><p>1 < 2</p><!-- open"), None) == "1 < 2"
    assert lines("") == []


def test_alignment_is_a_longest_common_subsequence():
    def length(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        return t[-1, -1]

    r = random.Random(0)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
        got = sorted(common(a, b))
        assert len(got) == length(a, b)
        it = iter(b)
        assert all(a[i] in it for i in got)


def test_pages_of_odd_tables(spark):
    schema = "page_id long, url string, html string, text string"
    assert extract(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "http://a.example/x", PAGE, "q"), (2, "http://a.example/y", None, None), (3, None, PAGE, None), (4, "no url", "", None), (1, "http://a.example/x", PAGE, "q")]
    got = sorted((r.id, r.text, r.n_chars) for r in extract(spark.createDataFrame(rows, schema)).collect())
    text = main_text(lines(PAGE), None)
    assert got == sorted([(1, text, len(text)), (1, text, len(text)), (2, "", 0), (3, text, len(text)), (4, "", 0)])


def brute(rows, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        on = ids != ids[q]
        order = np.lexsort((ids[on], d[on]))[:k]
        out[int(ids[q])] = list(zip(ids[on][order].tolist(), d[on][order].tolist()))
    return out


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(0, 1, (20, 16))
    x = (centre[rng.integers(0, 20, 4000)] + 0.4 * rng.normal(0, 1, (4000, 16))).astype(np.float32)
    x[500:900] = x[100]  # a hot vector, with queries among its copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [1.0] * 15 + [float("nan")]), (5100, [1.0] * 15 + [None]), (5200, [float("inf")] * 16), (None, [1.0] * 16), (5300, [1.0, 2.0]), (7, x[7].tolist())]
    df = spark.createDataFrame([(a, b, "z") for a, b in rows + odd], "vec_id long, embedding array<float>, score string")
    got = {}
    for r in nearest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows)
    assert set(got) == set(want)
    hits = 0
    for q, v in got.items():
        v.sort()
        assert [r for r, _, _ in v] == list(range(1, 11)) and sorted(v, key=lambda t: (t[2], t[1])) == v
        hits += len({i for _, i, _ in v} & {i for i, _ in want[q]})
        for _, i, s in v:
            assert abs(s - np.sqrt(((x[q].astype(float) - x[i]) ** 2).sum())) < 1e-12
    assert hits / (10 * len(want)) >= 0.9
    assert [i for _, i, _ in got[500]] == [i for i, _ in want[500]]


def test_neighbours_of_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest(spark.createDataFrame([], schema)).count() == 0
    few = nearest(spark.createDataFrame([(0, [1.0, 0.0]), (100, [1.0, 0.0]), (3, [0.0, 1.0])], schema)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in few) == [(0, 1, 100), (0, 2, 3), (100, 1, 0), (100, 2, 3)]


def test_conditionals_sum_to_one_and_scores_are_sums(spark):
    rng = np.random.default_rng(0)
    net = lm_score.Net.start(rng.integers(1, 100, lm_score.SLOTS).astype(float))
    ctx = [rng.integers(0, lm_score.SLOTS + 1, 1) for _ in lm_score.OFFSETS]
    every = np.arange(lm_score.SLOTS)
    p = np.exp(net.log_prob([np.repeat(c, len(every)) for c in ctx], every))
    assert abs(p.sum() - 1) < 1e-3
    vocab = lm_score.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.ones(lm_score.SLOTS))
    texts = ["a b c d e", None, "", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r for r in lm_score.score(df, vocab, net).collect()}
    assert got[1].log_prob == 0 and got[1].n_tokens == 0 and got[1].mean_log_prob is None and got[2].n_tokens == 0
    (_, _, padded, (place, _, _)), *_ = lm_score._tokens(pa.array(texts[:1]), vocab)
    want = sum(float(net.log_prob([padded[[at + o]] for o in lm_score.OFFSETS], padded[[at]])[0]) for at in place)
    assert got[0].n_tokens == 5 and got[0].log_prob == pytest.approx(want, rel=1e-5)


def test_training_learns_word_order(spark):
    r = random.Random(0)
    text = [" ".join(w for _ in range(60) for w in r.choice([["one", "two", "three"], ["red", "green", "blue"]])) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string").repartition(3)
    vocab, net = lm_score.train(df)
    shuffled = [" ".join(r.sample(t.split(), len(t.split()))) for t in text[:40]]
    test = spark.createDataFrame([(i, t) for i, t in enumerate(text[:40])] + [(1000 + i, t) for i, t in enumerate(shuffled)], "doc_id long, text string")
    got = {x.id: x.mean_log_prob for x in lm_score.score(test, vocab, net).collect()}
    assert np.mean([got[i] - got[1000 + i] for i in range(40)]) > 0.3
    empty_vocab, empty_net = lm_score.train(df.limit(0))
    assert lm_score.score(df.limit(0), empty_vocab, empty_net).count() == 0
