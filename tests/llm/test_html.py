import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from cartospark.llm import html_wrapper as W

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x="</p>";</script></head><body class="has-sidebar">
<header><a href=/>Home</a> Site header</header><nav><ul><li>One<li>Two</ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy {n}</div>
<aside>Side {n}</aside>{body}<div id="comments"><article><p>A reader says {n}</p></article></div><form><input value=1><button>Send</button></form><footer>&copy; site &middot; {n}</footer></body></html>"""


def test_parts_that_are_not_content():
    body = '<article><h1>Head &amp; tail</h1><p>One <b>bo</b>ld\n word<br>two&nbsp;x<p>Three<!-- gone -->.</p><ul><li>a<li>b</ul><div class="share">Share me</div><p hidden>no</p></article>'
    assert W.main_text(PAGE.format(n=1, body=body)) == "Head & tail One bold word two x Three. a b"


@pytest.mark.parametrize("html,text", [("", ""), ("plain &lt;text&gt;", "plain <text>"), ("<p>a<p>b", "a b"), ("<div><p>unclosed <i>x", "unclosed x"), ("<!-- only", ""), ("<p>a &am</p><p>b &amp", "a &am b &"), ("<table><tr><td>1<td>2</table>", "1 2"), ('<p title="a>b">c</p>', "c")])
def test_loose_html(html, text):
    assert W.main_text(html) == text


def test_deep_and_wide_pages():
    assert W.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    wide = "<article>" + "".join(f"<p>w{i}</p><i>x</i>" for i in range(3000)) + "</article>"
    assert W.main_text(wide, [W.Template(wide.replace("<i>", "<b>").replace("</i>", "</b>"))], [0], 0).startswith("w0 x w1")


def test_closings_below_any_depth_match_their_own_openings():
    deep = "<div id=page><article>" + "<div>" * 250 + "x<nav>menu</nav>" + "</div>" * 250 + "<p>rest</p></article></div>"
    assert W.main_text(deep) == "x rest"
    changed = deep.replace("menu", "<i>m</i>")
    assert len(W.align(W.parse(deep), W.parse(changed))) == W.parse(deep).size
    assert W.main_text("<article>" + "<div>" * 20_000 + "a" + "</div>" * 20_000 + "b</article>") == "a b"


def test_child_inserted_into_a_wide_page(monkeypatch):
    row = lambda i: f"<p class=c{i}>w{i}</p>"
    a = W.parse("<div>" + row("x") + "".join(map(row, range(1200))) + row("y") + "</div>")
    b = W.parse("<div>" + row("q") + row("new") + "".join(map(row, range(1200))) + row("z") + "</div>")
    assert sum(x.label.startswith("p.") and x.label == y.label for x, y in W.align(a, b)) == 1200
    import random

    rng = random.Random(3)
    monkeypatch.setattr(W, "CELLS", 6)
    for _ in range(60):
        a, b = (W.parse("".join(f"<{t}>{'<b>x</b>' * rng.randint(0, 2)}</{t}>" for t in rng.choices(["div", "section", "ul"], k=rng.randint(1, 14)))) for _ in range(2))
        assert len(W.align(a, b)) == plain_match(a, b) == W.matched_nodes(a, b, {})


def plain_match(a, b):
    """Simple tree matching by the book."""
    if a.label != b.label:
        return 0
    m = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids, 1):
        for j, y in enumerate(b.kids, 1):
            m[i][j] = max(m[i][j - 1], m[i - 1][j], m[i - 1][j - 1] + plain_match(x, y))
    return m[-1][-1] + 1


def test_alignment_is_the_largest_one():
    import random

    rng = random.Random(8)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1)}</{t}>" for t in (rng.choice(["div", "section", "span", "ul"]) for _ in range(rng.randint(0, 4)))) if depth else "x"

    for _ in range(60):
        a, b = W.parse(tree(3)), W.parse(tree(3))
        assert len(W.align(a, b)) == plain_match(a, b) == W.matched_nodes(a, b, {})


def test_template_of_a_host(spark):
    """No article element: constant parts go, varying slots stay."""
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    page = lambda i: f"<html><body><div><p>Welcome to the portal of news</p><div><h2>Title {words[i % 8]} {i}</h2><p>Story {i} of {words[i % 7]} and more of the same long story text.</p><p>All rights are kept by us</p></div></div></body></html>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(20)] + [(100, "http://lone.example/a", page(3)), (101, None, None), (102, "not a url", ""), (None, "http://h.example/9", page(5)), (103, "http://h.example/3", page(3)), (103, "http://h.example/3", page(3))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    found = {(r.page_id, r.url): r.main_text for r in W.extract_main_text(df).collect()}
    for i in range(20):
        assert found[i, f"http://h.example/{i}"] == f"Title {words[i % 8]} {i} Story {i} of {words[i % 7]} and more of the same long story text."
    assert "Welcome" in found[100, "http://lone.example/a"] and found[101, None] == "" and found[102, "not a url"] == ""
    assert W.extract_main_text(df).count() == len(rows) and W.extract_main_text(df.limit(0)).count() == 0


def extracted(spark, pages, host="h.example"):
    df = spark.createDataFrame([(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.main_text for r in W.extract_main_text(df).collect()}


STORY = "Story {i} tells of {w} and of {w} again, at some length, so that the page has text."
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


@pytest.mark.parametrize("n", [2, 3, 5, 7, 9])
def test_hosts_of_any_size(spark, n):
    """No semantic tags, no telling names: two different pages are enough to tell the template from the story."""
    page = lambda i: f"<html><body><div id=x><div class=q1>Home of all things, since 1990, with more to say in every menu</div><div class=q2><div>{STORY.format(i=i, w=WORDS[i])}</div><div>More {WORDS[-i - 1]} {STORY.format(i=9 * i, w=WORDS[i - 1])}</div></div><div class=q3>All words are ours; the story is yours to read and to tell</div></div></body></html>"
    found = extracted(spark, map(page, range(n)))
    assert found == {i: f"{STORY.format(i=i, w=WORDS[i])} More {WORDS[-i - 1]} {STORY.format(i=9 * i, w=WORDS[i - 1])}" for i in range(n)}


def test_every_article_stays_and_the_site_header_goes(spark):
    page = lambda i: f"<body><header><a href=/>Site</a> of the day {i}</header><nav>Menu</nav><article><header><h1>One {i}</h1></header><p>{STORY.format(i=i, w=WORDS[i])}</p></article>" + (f"<article><p>Two {i}. {STORY.format(i=-i, w=WORDS[i])}</p></article>" if i % 2 else "") + "<footer>f</footer></body>"
    want = lambda i: f"One {i} {STORY.format(i=i, w=WORDS[i])}" + (f" Two {i}. {STORY.format(i=-i, w=WORDS[i])}" if i % 2 else "")
    assert extracted(spark, map(page, range(6))) == {i: want(i) for i in range(6)}
    assert W.main_text(page(3)) == want(3)


def test_republished_pages_keep_their_text(spark):
    """Copies that differ in a date, also where they are nearly all of a host's pages."""
    page = lambda date, body: f"<body><div class=a>Daily paper</div><div class=b><p>{date}</p><p>{body}</p><p>{body[::-1]}</p></div></body>"
    copies = [page(f"Day {i}", "The same long story that is told on each day anew, and again.") for i in range(30)]
    others = [page(f"Day {i}", STORY.format(i=i, w=WORDS[i])) for i in range(3)]
    for pages in (copies + others, others + copies, copies):
        for i, text in extracted(spark, pages).items():
            body = re.search("</p><p>(.*?)</p>", pages[i])[1]
            assert body in text and body[::-1] in text, (i, text)


def test_names_say_something_only_alone():
    page = '<article><h1>T</h1><section id="comment-on-policy"><p>a</p></section><div class="login"><p>b</p></div><div class="no-ads">c</div><div class="post-comments">x</div><div class="adSlot_3">x</div><div class="newsletter">x<input></div><aside>x</aside></article>'
    assert W.main_text(page) == "T a b c"


def test_form_round_the_page():
    assert W.main_text("<body><form id=f><nav>x</nav><div><p>a</p><p>b</p><p>c</p></div><input></form></body>") == "a b c"


def test_pages_of_several_layouts(spark):
    """The smallest page of the host has no text, and two layouts take turns."""
    one = lambda i: f"<body><div class=menu1>Go here</div><div class=main1><p>{STORY.format(i=i, w=WORDS[i])}</p></div></body>"
    two = lambda i: f"<body><section><div>Short notes of ours, which are always the same for all</div><section><p>{STORY.format(i=i, w=WORDS[-i])}</p></section></section></body>"
    found = extracted(spark, ["", None, "<html></html>"] + [(one, two)[i % 2](i) for i in range(10)])
    assert found == {0: "", 1: "", 2: ""} | {i + 3: STORY.format(i=i, w=WORDS[i] if i % 2 == 0 else WORDS[-i]) for i in range(10)}


@pytest.mark.parametrize("unit", ['<a href="x ', "<a href='x ", "<a ", '<a b="c">\' ', "<", '<a ""', "</p ", "<!-- x ", "<script>", "<a b=c", "&amp", '<p class="a b" "'])
def test_broken_markup_takes_linear_time(unit):
    import time

    start = time.time()
    for end in ("", '"', ">", "'>"):
        W.main_text(unit * (1_000_000 // len(unit)) + end)
    assert time.time() - start < 60


def test_join_by_host_gives_the_same(spark, tiny, monkeypatch):
    pages = spark.read.parquet(f"{tiny}/pages.parquet")
    key = lambda: sorted((r.page_id, r.main_text) for r in W.extract_main_text(pages).select("page_id", "main_text").collect())
    one = key()
    monkeypatch.setattr(W, "BROADCAST_BYTES", 0)
    assert one == key()


def test_given_pages(spark, tiny):
    for r in W.extract_main_text(spark.read.parquet(f"{tiny}/pages.parquet")).collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        plain = re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", inner))
        assert r.main_text == " ".join(unescape(plain).split()), r.page_id


def test_pages_do_not_move_to_meet_small_tables(spark, monkeypatch):
    """Seeds and repeated pages are found by keys that are sent to the pages; by a shuffle, texts are the same."""
    page = lambda i: f"<html><body><div class='menu'>Home News</div><div><p>Story {i} tells of {i * 7} things, at length and in words of its own.</p></div></body></html>"
    rows = [(k, f"http://h{k % 3}.org/{k}", page(k % 20)) for k in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    plans, keep = {}, W.Scratch.keep

    def watched(self, frame, name, *more):
        plans[name] = frame._jdf.queryExecution().executedPlan().toString()
        return keep(self, frame, name, *more)

    monkeypatch.setattr(W.Scratch, "keep", watched)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as tables whose size isn't known are planned
    try:
        sent = {r.page_id: r.main_text for r in W.extract_main_text(df).collect()}
        assert "BroadcastHashJoin" in plans["seeds"] and "SortMergeJoin" not in plans["seeds"]
        monkeypatch.setattr(W, "BROADCAST_KEYS", 0, raising=False)
        assert {r.page_id: r.main_text for r in W.extract_main_text(df).collect()} == sent
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert all(f"Story {k % 20} tells of" in sent[k] and "Home" not in sent[k] for k in sent)
