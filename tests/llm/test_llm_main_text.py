import random
import re

import numpy as np
import pytest
from edge_cases import keep

from inspectlake.llm import boosting, main_text
from inspectlake.llm.dom import TAGS, Forest
from inspectlake.llm.layouts import drawn_pages
from inspectlake.llm.sampling import hash_limit

SCHEMA = "page_id long, url string, html string, text string, n_chars int"


@pytest.fixture(scope="module")
def pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return main_text.fit(pages, keep)


def blocks(html):
    forest = Forest()
    forest.add(html)
    return [(list(TAGS)[t], x) for t, x in zip(forest.tag, forest.text) if x]


def article(html):
    """What stands between the article tags, read by patterns."""
    inner = html[html.index("<article>") + 9 : html.index("</article>")]
    texts = (re.sub(r"<[^>]*>", " ", part) for part in re.split(r"</?(?:p|h1)>", inner))
    import html as entities

    return "\n\n".join(t for t in (" ".join(entities.unescape(x).split()) for x in texts) if t)


def test_articles_of_the_table(pages, model):
    rows = main_text.extract(pages, model).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(rows) == pages.count()
    wrong = [r.page_id for r in rows if r.text != article(r.html)]
    assert len(wrong) <= 1 and all(r.n_chars == len(r.text) for r in rows)


def test_drawn_pages_it_did_not_learn_from(model):
    rng = random.Random(77)
    words = ["w%d" % rng.randrange(5000) for _ in range(900)]
    found = wanted = both = 0
    for seed in range(10_000, 10_060):
        for page in drawn_pages(seed, words, 3):
            forest = Forest()
            forest.add(page)
            inside = forest.arrays()
            mark = [None if m is None else m == "main" for m in forest.mark]
            for i in range(1, inside.n):
                mark[i] = mark[forest.parent[i]] if mark[i] is None else mark[i]
            want = {(i, t) for i, t in enumerate(forest.text) if t and mark[i]}
            state = inside.decode(boosting.log_shares(inside.features(main_text.TokenScores(model["scores"])), model["trees"]))
            got = {(i, t) for i, t in enumerate(forest.text) if t and state[i] == main_text.IN}
            size = [sum(len(t) for _, t in s) for s in (got, want, got & want)]
            found, wanted, both = found + size[0], wanted + size[1], both + size[2]
    assert both / found > 0.97 and both / wanted > 0.97


def test_parts_put_into_a_page(model):
    words = "some words of a text that goes on for a while and then ends here".split()
    body = "".join(f"<p>{' '.join(words[k:] + words[:k])} number {k}.</p>" for k in range(8))
    for other in (
        '<aside class="sidebar"><h3>More</h3><p>other words of a sidebar that says much</p></aside>',
        '<div class="cookie-notice">this site uses things and wants you to agree<button>OK</button></div>',
        '<div class="ad">buy this now and here</div>',
        '<section id="comments"><div class="comment"><b>Ann</b><p>what a fine text that was</p></div><div class="comment"><b>Bo</b><p>I do not agree at all</p></div></section>',
        '<form class="newsletter"><label>Your mail</label><input><button>Go</button></form>',
        "<script>var a = '<p>not text</p>';</script><style>p{}</style>",
    ):
        for page in (
            f"<html><body><nav><a href=a>Home</a></nav>{other}<article><h1>Title of it</h1>{body}</article><footer>&copy; me</footer></body></html>",
            f"<html><body><nav><a href=a>Home</a></nav><article><h1>Title of it</h1>{body}{other}</article><footer>&copy; me</footer></body></html>",
        ):
            (text,) = main_text.texts_of([page], model)
            assert text.startswith("Title of it\n\nsome words") and text.endswith("number 7."), (other, text)


def test_blocks_of_broken_markup():
    assert blocks("<p><b>One<br>two<p>three") == [("p", "One two"), ("p", "three")]
    assert blocks("a &lt; b &amp c &am; 1 < 2 <!-- x --> y<!-- open") == [("#text", "a < b & c &am; 1 < 2 y")]
    assert blocks("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>") == [("li", "a"), ("li", "b"), ("td", "c"), ("td", "d"), ("td", "e")]
    assert blocks("<div>loose<p>in</div>after") == [("#text", "loose"), ("p", "in"), ("#text", "after")]
    assert blocks("<head><title>t</title>\n<body>x<textarea>y</p></textarea><select><option>z</select>&nbsp;\n w") == [("#text", "x w")]
    assert blocks("<p title='a>b' data-x=it's>c</p></div></p></article>d") == [("p", "c"), ("#text", "d")]
    assert blocks("<script>never closed <p>x") == [] == blocks("") == blocks("<p> \n</p><")[1:]
    assert blocks("<div>" * 50_000 + "x" + "</p>" * 50_000) == [("div", "x")]
    assert blocks("<td><p>a<table><tr><td></p>b</table>c")[-1][1] == "c"


def test_states_are_consistent():
    rng = np.random.default_rng(2)
    for seed in range(20):
        forest = Forest()
        forest.add(drawn_pages(seed, ["a", "b", "c"], 1)[0])
        arrays = forest.arrays()
        odds = np.log(rng.dirichlet(np.ones(3), arrays.n))
        state = arrays.decode(odds)
        for i in range(1, arrays.n):
            up = state[arrays.parent[i]]
            assert up == 2 or state[i] == 0 or (up == 1 and state[i] == 1)
        assert not (state[arrays.chars > 0] == 2).any()
        # No other consistent choice of a small tree is better.
        if arrays.n <= 9:
            total = odds[np.arange(arrays.n), state].sum()
            for choice in np.ndindex(*[3] * arrays.n):
                fits = all(choice[arrays.parent[i]] == 2 or choice[i] == 0 or (choice[arrays.parent[i]] == 1 and choice[i] == 1) for i in range(1, arrays.n))
                if fits and not any(c == 2 and arrays.chars[i] for i, c in enumerate(choice)):
                    assert odds[np.arange(arrays.n), choice].sum() <= total + 1e-9


def test_boosting_learns_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    y = np.where(x[:, 0] * x[:, 1] > 0, 1, np.where(x[:, 2] > 1, 2, 0))
    model = boosting.fit(x[:2000], y[:2000], 3)
    assert (boosting.log_shares(x[2000:], model).argmax(axis=1) == y[2000:]).mean() > 0.93
    assert np.allclose(np.exp(boosting.log_shares(x, model)).sum(axis=1), 1)


def test_edge_rows(spark, pages, model):
    long = "<article><h1>T</h1>" + "<p>many words in it</p>" * 20_000 + "</article>"
    rows = [(None, None, None, "x", 1), (1, "u", "", "x", 1), (2, "u", long, "x", 1), (2, "u", long, "x", 1), (3, None, "no markup at all", None, None), (4, "v", "<nav><a href=x>y</a></nav>", "", 0)]
    table = spark.createDataFrame(rows, SCHEMA)
    found = main_text.extract(table, model)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(((r.page_id or 0, r.text) for r in found.collect()))
    assert [g for g in got if g[0] in (0, 1)] == [(0, ""), (1, "")]
    assert [g[1].count("many words in it") for g in got if g[0] == 2] == [20_000, 20_000]
    assert main_text.extract(table.limit(0), model).count() == 0
    empty = table.limit(0)
    assert main_text.fit(empty, keep) is None
    assert [r.text for r in main_text.extract(table.where("page_id = 1"), None).collect()] == [""]


def test_samples_never_vanish():
    assert hash_limit(300, 10) == 2**63 - 1
    for rows in (10**3, 10**9, 10**12, 10**18):
        limit = hash_limit(300, rows)
        assert limit >= 1 and abs(limit / 2**63 * rows - 300) < 1
