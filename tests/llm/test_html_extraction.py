import os
import random

import pytest
from compare import check_engine, compare

from civiclake.llm import html_extraction as X
from civiclake.llm import queries

SCHEMA = "page_id long, url string, html string, _row string, _text int, gold string"


def around(article, before="", after="", mark="article"):
    return (f"<!DOCTYPE html><html><head><title>Some title</title><style>p{{x:1}}</style><script>var t='</p><article>';</script></head><body>"
            f"<nav><ul><li><a href=/>Home page</a><li><a>About us</a></ul></nav>{before}<{mark}>{article}</{mark}>{after}"
            f"<footer>&copy; All rights kept here.</footer></body></html>")


def text(page, weights=None):
    return X.main_text(page, weights or X.Weights())


def test_the_scan_finds_the_best_run():
    rnd = random.Random(3)
    for _ in range(500):
        values = [rnd.choice([-3.0, -1.0, 0.0, 1.0, 2.0]) for _ in range(rnd.randrange(12))]
        runs = [(sum(values[a:b]), -a, b) for a in range(len(values)) for b in range(a + 1, len(values) + 1)]
        best = max((r for r in runs if r[0] > 0), default=None)
        a, b = X.best_run(values)
        assert (a, b) == (0, 0) if best is None else sum(values[a:b]) == best[0]


@pytest.mark.parametrize("page, expected", [
    (around("<h1>Head line</h1><p>One two &amp; three.<p>Four"), "Head line One two & three. Four"),
    (around("<p><b>un<i>brok</i>en</b> word<br>next\n\t line&nbsp;x</p><p>&am; &#233;&eacute</p>"), "unbroken word next line x &am; éé"),
    (around("<p>First part.</p><div class='ad big'>Buy this now, it is cheap.</div><p>End.</p>"), "First part. End."),
    (around("<header><h1>Own head</h1></header><p>Text here.</p><aside>Not this.</aside><p>More.</p><form><label>Mail</label><input></form><p>Last one.</p>"),
     "Own head Text here. More. Last one."),
    (around("<p>Text of the article.</p><section id=\"comments\"><p>First!</p><p>I like this article a lot, it has many words.</p></section>"), "Text of the article."),
    (around("<p>Text.</p>", before="<header class='site-header'><p>The site of sites</p></header><div role=alert>We use cookies here.</div>",
            after="<div class='comment-list'><p>Reader says that.</p></div><aside>See also</aside>"), "Text."),
    (around("<p>See <a href='x'>this one</a></p><ul><li>a point<li><a>linked point</a></ul>"), "See this one a point linked point"),
    (around("<p>1 < 2 and <!-- not > this --> a<b</p>"), "1 < 2 and a"),
    (around("<p>In main.</p>", mark="main"), "In main."),
    ("<p>just a paragraph</p>", "just a paragraph"), ("no markup at all", "no markup at all"), ("", ""), (None, ""), ("<nav>Home</nav>", ""),
    ("<p>cut off <a hre", "cut off"), ("<p>open <!-- never closed", "open"), ("<script>x", ""), ("<p>&lt;b&gt;", "<b>"), ("</p></div></article>", "")])
def test_pages_by_the_fixed_lists(page, expected):
    assert text(page) == expected


def plain_page(n, words=60):
    rnd = random.Random(n)
    body = "".join(f"<p>{' '.join(rnd.choice(['lorem', 'ipsum', 'dolor', 'sit']) for _ in range(rnd.randrange(3, words)))}.</p>" for _ in range(6))
    return body, around(body, before=f"<div class=x17>{'Offer of the day ' * rnd.randrange(1, 9)}</div>", after="<p>Loose words at the end</p>")


@pytest.fixture(scope="module")
def learned(spark):
    pages = spark.createDataFrame([(i, "u", plain_page(i)[1], "r", 1, None) for i in range(200)], SCHEMA)
    return X.learn(pages, max_labelled=150)


def test_weights_learned_from_marked_pages(learned):
    body, page = plain_page(999)
    expected = " ".join(body.replace("<p>", " ").replace("</p>", " ").split())
    assert text(page, learned) == expected
    assert learned.place(".x17") < learned.outside  # a class seen around articles only
    unmarked = page.replace("<article>", "<div>").replace("</article>", "</div>").replace("</script>", "<article>';</script>", 1)
    assert text(unmarked, learned) == expected
    listed = around("<p>Many words stand in this paragraph.</p><ul><li>one</li><li><a>two</a></li></ul><div><p>three</p></div>")
    assert text(listed, learned) == "Many words stand in this paragraph. one two three"


def test_labels_may_be_texts(spark):
    rows = []
    for i in range(60):
        body, _ = plain_page(i)
        gold = " ".join(body.replace("<p>", " ").replace("</p>", " ").split())
        rows.append((i, "u", f"<body><div class=top17>Words on top of it all</div><div>{body}</div><div class=low17>And below</div></body>", "r", 1, gold))
    weights = X.learn(spark.createDataFrame(rows, SCHEMA), label_col="gold")
    assert all(text(r[2], weights) == r[5] for r in rows)


def test_odd_tables(spark):
    rows = [(1, None, None, "r", 1, None), (None, "u", "", None, None, None), (2, "u", around("<p>x</p>"), "r", 1, None)] * 2
    rows.append((3, "u", around("<p><b>" + "word " * 300_000 + "</p>" + "<p><b>x" * 20_000), "r", 1, None))
    pages = spark.createDataFrame(rows, SCHEMA)
    done = X.extract(pages, X.learn(pages)).select("_row.page_id", "_text").collect()
    assert sorted(((r[0], len(r[1])) for r in done), key=repr) == sorted([(1, 0), (1, 0), (None, 0), (None, 0), (2, 1), (2, 1), (3, 5 * 300_000 - 1 + 40_000)], key=repr)
    none = pages.limit(0)
    assert X.extract(none, X.learn(none)).count() == 0


def test_query_equals_its_sql(spark):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    assert compare(spark, check_engine(sf), queries.QUERIES["op11_html_extraction"], queries.ORACLES["op11_html_extraction"], sf) is None
