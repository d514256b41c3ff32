"""Page operators on small hand-made pages."""

import itertools
import random
import re
from html.parser import HTMLParser

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from galley.functions.markup import decode_entities
from galley.operators.dom import dom_rows, node_attributes, node_table, tokenize, with_places
from galley.operators.records import page_records
from galley.operators.reports import removed_report
from galley.plans.articles import article_errors, extract_articles
from galley.sources.pages import PAGES
from galley.operators.selectors import attach_site, match_selectors
from galley.sources.rules import (
    RULE_SCHEMA,
    UNSUPPORTED,
    load_site_rules,
    selector_rows,
    site_table,
    validate_site_rules,
)

LINES = [
    "The council met on Monday evening and talked for hours about the new bridge over the river.",
    "Several speakers asked who would pay for it, and the mayor promised a full answer by spring.",
    "Engineers said the old bridge could carry traffic for five more years at the very most.",
    "Shop owners near the river feared that a long closure would keep their customers away.",
    "A vote on the plan is expected in March, after the public has had time to comment on it.",
]
BODY = "".join(f"<p>{line}</p>" for line in LINES)


def pages(spark, *htmls, url="https://news.example.org/a"):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], PAGES)


def article(spark, html, url="https://news.example.org/a", rules=None):
    return extract_articles(pages(spark, html, url=url), rules).collect()[0]


def test_page_without_container(spark):
    row = article(spark, f"<html><body><h1>Bridge plan debated</h1>{BODY}</body></html>")
    assert row.word_count > 50 and row.paragraph_count == 5
    assert row.extractor_method == "generic_fallback"
    assert row.title == "Bridge plan debated"


def test_boilerplate_is_removed(spark):
    html = (
        "<html><body><nav>Menu here</nav><header>Top line</header><main><article><h1>Bridge plan debated</h1>"
        f"{BODY}</article></main><aside class='sidebar'>Side matter</aside><footer>Imprint</footer>"
        "<script>track('x')</script></body></html>"
    )
    row = article(spark, html)
    assert "council met" in row.clean_content
    for word in ("Menu here", "Top line", "Side matter", "Imprint", "track"):
        assert word not in row.clean_content
    report = {r.reason: r.n for r in removed_report(dom_rows(pages(spark, html))).collect()}
    assert report == {"tag:nav": 1, "tag:header": 1, "tag:aside": 1, "tag:footer": 1, "script_style:script": 1}


def test_custom_site_rules(spark):
    html = f"<div class='content'><h2 class='title'>Bridge plan debated</h2><div class='article-body'>{BODY}</div></div><div class='sidebar'>No</div>"
    custom = spark.createDataFrame(
        [("news.example.org", ".title", ".article-body p", None, None, ["p"])],
        "domain STRING, title_selector STRING, content_selector STRING, author_selector STRING, "
        "date_selector STRING, fallback_selectors ARRAY<STRING>",
    )
    row = article(spark, html, rules=load_site_rules(spark, custom))
    assert row.extractor_method == "site_specific"
    assert row.extraction_method == "site_specific_news.example.org"
    assert row.title == "Bridge plan debated" and row.paragraph_count == 5


def test_unicode_text(spark):
    html = "<p>Café, naïve, résumé: words with accents stay as they are in all of this text, always.</p><p>你好世界 and € £ ¥ too, with enough words to make this paragraph count for the test.</p>"
    row = article(spark, html)
    assert "Café" in row.clean_content and "你好世界" in row.clean_content and "€ £ ¥" in row.clean_content


def test_malformed_page(spark):
    row = article(spark, "<html><body><p>Open paragraph <div>Never closed <p>Another one</p><script>var a = '</p>'")
    assert row.extractor_method == "generic_fallback" and "var a" not in row.clean_content


def test_known_site_selectors(spark):
    html = (
        '<h1 data-gu-name="headline">A test of headlines</h1><div data-gu-name="body"><p>One sentence with more than five words.</p>'
        '<p>Another sentence with more than five words.</p></div><a rel="author">Ann Writer</a><time datetime="2024-01-01T12:00:00Z">x</time>'
    )
    row = article(spark, html, "https://www.theguardian.com/x")
    assert row.title == "A test of headlines" and row.author == "Ann Writer"
    assert str(row.publish_date) == "2024-01-01 12:00:00"
    assert row.content.count("\n\n") == 1 and row.extraction_method == "site_specific_theguardian.com"


def test_inline_tags_and_comments_separate_runs(spark):
    html = "<article><p>foo<b>bar</b> a<!-- x -->b &amp;amp; &#233;&eacute;</p></article>"
    toks = page_records(pages(spark, html)).select(F.explode("kept_runs").alias("r")).collect()
    assert [t.r.strip() for t in toks] == ["foo", "bar", "a", "b &amp; éé"]


def test_entities(spark):
    row = spark.range(1).select(decode_entities(F.lit("&lt;&#x41;&#65;&nosuch;&amp;lt; &#99999999; & x")).alias("t")).first()
    assert row.t == "<AA&nosuch;&lt; � & x"


def test_attributes(spark):
    nodes = node_table(pages(spark, """<a HREF='x>y' class="b  c" data-ad hidden="" class=z>t</a>"""))
    attrs = node_attributes(nodes).first().attrs
    assert attrs == {"href": "x>y", "class": "z", "data-ad": "", "hidden": ""}


def test_quote_that_never_ends(spark):
    kinds = [r.kind for r in tokenize(pages(spark, "<p title=\"it's>text</p>")).orderBy("pos").collect()]
    assert kinds == ["open", "text", "close", "eof"]


def test_unclosed_node_ends_with_its_parent(spark):
    nodes = {r.tag: (r.start, r.end) for r in node_table(pages(spark, "<div><span>a<b>c</div>d<i>e")).collect()}
    assert nodes["span"][1] == nodes["b"][1] == nodes["div"][1] == 5
    assert nodes["i"][1] == 9  # the end of the page


def test_paragraph_closes_paragraph(spark):
    nodes = [(r.start, r.end) for r in node_table(pages(spark, "<div><p>a<p>b</div>c")).filter("tag = 'p'").collect()]
    assert sorted(nodes) == [(1, 3), (3, 5)]


def test_hidden_and_marked_nodes(spark):
    html = (
        "<div style='Display : none'>a</div><div data-ad='1'>b</div><div data-ad=''>c</div><div id='PROMO-x'>d</div>"
        "<div class='headline'>e</div><div class='plain'>f</div>"
    )
    kept = "".join(r.run for r in dom_rows(pages(spark, html)).filter("kept").orderBy("pos").collect())
    assert kept == "cf"
    kept = "".join(r.run for r in dom_rows(pages(spark, html), mode="token").filter("kept").orderBy("pos").collect())
    assert kept == "cdef"


def test_unusable_pages(spark):
    rows = spark.createDataFrame(
        [(1, "https://a.org", None), (2, "https://a.org", " "), (3, "a.org", "<p>x</p>"), (4, "https://a.org", "<p>x</p>")],
        PAGES,
    )
    assert {r.page_id: r.error_type for r in article_errors(rows).collect()} == {
        1: "NULL_INPUT", 2: "empty_input", 3: "SCRAPING_ERROR",
    }
    assert [r.page_id for r in extract_articles(rows).collect()] == [1, 2, 4][2:]


PIECES = st.sampled_from(
    ["<div>", "</div>", "<p>", "</p>", "<b>", "</b>", "<section>", "</section>", "<br>", "x", "y z", "<a href=q>", "</a>", "<"]
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(PIECES, max_size=25).map("".join).filter(str.strip), min_size=1, max_size=12))
def test_node_intervals(spark, htmls):
    frame = pages(spark, *htmls)
    last = {r.page_id: r.m for r in tokenize(frame).groupBy("page_id").agg(F.max("pos").alias("m")).collect()}
    for node in node_table(frame).collect():
        void = node.tag == "br"
        assert node.end == node.start if void else node.start < node.end <= last[node.page_id]


def test_one_exchange_per_page_table(spark, tmp_path):
    html = f"<article>{BODY}</article>"
    pages(spark, html, html).write.parquet(str(tmp_path / "p"))
    frame = spark.read.schema(PAGES).parquet(str(tmp_path / "p"))
    plan = dom_rows(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan


def test_bucketed_pages_need_no_exchange(spark):
    html = f"<article>{BODY}</article>"
    spark.sql("DROP TABLE IF EXISTS bucketed_pages")
    try:
        pages(spark, html, html).write.bucketBy(4, "page_id").saveAsTable("bucketed_pages")
        plan = dom_rows(spark.table("bucketed_pages"), clustered=True)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan
        assert extract_articles(spark.table("bucketed_pages"), clustered=True).count() == 2
    finally:
        spark.sql("DROP TABLE IF EXISTS bucketed_pages")


@pytest.mark.parametrize("mode", ["substring", "token"])
def test_large_flat_page(spark, mode):
    """A page of many siblings stays linear: no pairs of nodes and runs are formed."""
    html = "<main>" + "".join(f"<div><p>{LINES[i % 5]}</p></div>" for i in range(3000)) + "</main>"
    row = extract_articles(pages(spark, html), mode=mode).first()
    assert row.word_count > 40_000


def test_custom_selectors(spark):
    html = """<body><div id="story" class="x y"><section class="a  b"><p class="q r" data-k="one, two">A</p></section><p>B</p></div>
      <div class="x"><p data-k="on">C</p><h1 class="a b">D</h1></div><article><div><div><p class="deep">E</p></div></div></article></body>"""
    selectors = {
        "#story p": "AB", "div#story.y > p": "B", ".x .a.b p": "A", "p.r.q": "A", "[data-k='one, two']": "A", "p[data-k^=on]": "AC",
        "p[data-k$='two']": "A", "section[class~=b] p": "A", "body .x p[data-k], h1.b.a": "ACD", "article div div p": "E",
        "article div div div p": "", "body article div div p": "E", "a b c d e f": None, "p:first-child": "ACE", "*": None, ", p": None, "P.Deep": "", "p.deep": "E",
        "section + p": "B", "section~p,h1:last-child": "BD", "div p:nth-of-type(1)": "ABCE", "p:not(.q):not([data-k=on])": "BE",
        "p:nth-child(2n)": "B", "p:nth-last-child( 2 )": "C", "div > div > :only-child": "E", "P:FIRST-CHILD": "ACE", "div>div>div>p": "", "article>div>div>p": "E",
        "p:hover": None, "p > > a": None, "> p": None, "p +": None, "p:not(:first-child)": None, "p:nth-child(x)": None, "p:not(a b)": None,
    }
    placed = {"div#story.y > p", "p:first-child", "P:FIRST-CHILD"} | {s for s in selectors if any(c in s for c in ">+:") or s.startswith("section~")}
    placed -= {"p:not(.q):not([data-k=on])"}
    pages = spark.createDataFrame([(k, f"https://own{k}.org/", html) for k in range(len(selectors))], PAGES)
    rules = [(f"own{k}.org", s, "p", None, None, []) for k, s in enumerate(selectors)]
    rules = spark.createDataFrame(rules, RULE_SCHEMA)
    faults = {r.value for r in validate_site_rules(rules).filter(f"message = '{UNSUPPORTED}'").collect()}
    left_out = {"p:hover", "p > > a", "> p", "p +", "p:not(:first-child)", "p:nth-child(x)", "p:not(a b)"}
    assert faults == {"a b c d e f", ", p"} | left_out
    sites = site_table(rules)
    for small in (True, False):
        rows = dom_rows(attach_site(pages, sites, small), ("site",))
        rows = rows if small else with_places(rows)
        hits = match_selectors(rows, selector_rows(sites), small).filter("field = 'title'")
        text = rows.filter("kind = 'text'").select("page_id", (F.col("pos") - 1).alias("start"), "run")
        found = {r.page_id: r.texts for r in hits.join(text, ["page_id", "start"]).groupBy("page_id").agg(F.sort_array(F.collect_list("run")).alias("texts")).collect()}
        for k, (selector, texts) in enumerate(selectors.items()):
            if texts is not None:
                # rows that know no places leave out what asks for them
                assert "".join(found.get(k, [])) == ("" if small and selector in placed else texts), selector


class Tree(HTMLParser):
    """Nodes with parent, place and class, for the plain matcher."""

    def __init__(self, html):
        super().__init__()
        self.nodes, self.open, self.top = [], [], []
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        parent = self.open[-1] if self.open else None
        siblings = parent["children"] if parent else self.top
        node = {"tag": tag, "class": dict(attrs).get("class"), "parent": parent, "siblings": siblings, "children": [], "text": ""}
        siblings.append(node)
        self.nodes.append(node)
        self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1]["text"] += data


def plain_match(node, steps):
    """``steps``: (sign before, tag, class, place) from the outermost."""
    sign, tag, name, place = steps[-1]
    family = [n for n in node["siblings"] if n["tag"] == node["tag"]] if "type" in place else node["siblings"]
    index = next(k for k, n in enumerate(family) if n is node) + 1
    if "last" in place:
        index = len(family) + 1 - index
    a, b = {"": (1, 1), "first": (0, 1), "last": (0, 1), "2n": (2, 0), "2n+1": (2, 1), "-n+2": (-1, 2)}[place.split(" ")[0]]
    stands = index == b if a == 0 else (index - b) % a == 0 and (index - b) / a >= 0
    if not ((tag in ("*", node["tag"])) and (name is None or node["class"] == name) and stands):
        return False
    if len(steps) == 1:
        return True
    at = next(k for k, n in enumerate(node["siblings"]) if n is node)
    ancestors, up = [], node["parent"]
    while up:
        ancestors.append(up)
        up = up["parent"]
    others = {">": ancestors[:1], " ": ancestors, "+": node["siblings"][max(0, at - 1) : at], "~": node["siblings"][:at]}[sign]
    return any(plain_match(n, steps[:-1]) for n in others)


def test_selectors_against_a_plain_matcher(spark):
    draw = random.Random(8)
    written = {"": "", "first": ":first-child", "last": ":last-child", "first type": ":first-of-type", "last type": ":last-of-type",
               "2n": ":nth-child(even)", "2n+1 last": ":nth-last-child(2n + 1)", "-n+2 type": ":nth-of-type(-n+2)"}

    def html(depth, numbers):
        parts = []
        for _ in range(draw.randint(1, 4)):
            tag, name = draw.choice(["div", "b", "em"]), draw.choice(["", ' class="x"', ' class="y"'])
            inner = html(depth - 1, numbers) if depth and draw.random() < 0.6 else ""
            parts.append(f"<{tag}{name}>t{next(numbers)}.{inner}</{tag}>")
        return "".join(parts)

    pages, rules, expected = [], [], {}
    for k in range(60):
        steps = [
            (draw.choice([" ", ">", "+", "~"]), draw.choice(["div", "b", "em", "*"]), draw.choice([None, None, "x", "y"]), draw.choice(["", "", *written]))
            for _ in range(draw.randint(1, 4))
        ]
        selector = "".join(
            ("" if k2 == 0 else f" {sign} ") + tag + (f".{name}" if name else "") + written[place] for k2, (sign, tag, name, place) in enumerate(steps)
        )
        page = html(4, itertools.count())
        pages.append((k, f"https://own{k}.org/", page))
        rules.append((f"own{k}.org", selector, "p", None, None, []))
        expected[k] = sorted(n["text"].split(".")[0] for n in Tree(page).nodes if plain_match(n, steps))
    sites = site_table(spark.createDataFrame(rules, RULE_SCHEMA))
    rows = with_places(dom_rows(attach_site(spark.createDataFrame(pages, PAGES), sites, False), ("site",)))
    hits = match_selectors(rows, selector_rows(sites), False).filter("field = 'title'")
    text = rows.filter("kind = 'text'").select("page_id", (F.col("pos") - 1).alias("start"), "run")
    found = {k: [] for k in expected}
    for row in hits.join(text, ["page_id", "start"]).collect():
        found[row.page_id].append(row.run.split(".")[0])
    assert {k: sorted(v) for k, v in found.items()} == expected
    assert sum(map(bool, expected.values())) > 20


def test_places_of_crossing_and_unclosed_nodes(spark):
    html = "<ul><li>a<li>b</ul><b><i>c</b>d</i><p>e<p>f<br>g"
    rows = with_places(dom_rows(spark.createDataFrame([(1, "u", html), (2, "u", ""), (3, "u", None), (4, "u", "text")], PAGES)))
    found = {r.pos: (r.tag, r.place.parent, r.place.nth, r.place.nth_last, r.place.nth_type) for r in rows.filter("place IS NOT NULL").collect()}
    by_tag = [found[k][0] for k in sorted(found)]
    assert by_tag == ["ul", "li", "li", "b", "i", "p", "p", "br"]
    assert found[0][1:] == (None, 1, 4, 1) and found[1][1] == 0
    assert all(r.place is None for r in rows.filter("kind NOT IN ('open', 'void')").collect())


def test_custom_places_reach_the_articles(spark):
    html = "<html><body><div><p>skip this first paragraph of the whole page please</p><p>one two three four five six seven eight</p></div><h1>A headline that is long enough</h1></body></html>"
    pages = spark.createDataFrame([(1, "https://own.org/a", html)], PAGES)
    rules = spark.createDataFrame([("own.org", "div + h1", "div > p:nth-child(n+2)", None, None, [])], RULE_SCHEMA)
    row = extract_articles(pages, rules).first()
    assert row.title == "A headline that is long enough" and row.content == "one two three four five six seven eight"


def test_many_rules_do_not_gather_pages_of_a_site(spark):
    pages = spark.createDataFrame([(1, "https://a.org/1", "<p>x</p>")], PAGES)
    rules = load_site_rules(spark, spark.createDataFrame([("b.org", "h1", "p", None, None, ["p"])], RULE_SCHEMA))
    plan = page_records(pages, rules)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    by_site = [k for k, line in enumerate(lines) if "Exchange hashpartitioning(site" in line and "_salt" not in line]
    assert all("Aggregate(key=[site" in lines[k + 1] or "Aggregate(keys=[site" in lines[k + 1] for k in by_site)  # the rules themselves
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_parts_of_pages_follow_their_size(spark, monkeypatch):
    """A task must not grow with the input: the number of parts is set by the lengths of the pages, rules of a user included."""
    from galley.operators import skew

    frame = pages(spark, *[f"<article>{BODY}</article>"] * 20)
    size = frame.agg(F.sum(F.length("html"))).first()[0]
    monkeypatch.setattr(skew, "PART_CHARS", -(-size // 37))
    plan = dom_rows(frame)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(page_id#\d+L, 37\), REPARTITION_BY_NUM", plan)) == 1
    rules = load_site_rules(spark, spark.createDataFrame(
        [("a.org", "h1", "article > p", None, None, [])],
        "domain STRING, title_selector STRING, content_selector STRING, author_selector STRING, date_selector STRING, fallback_selectors ARRAY<STRING>",
    ))
    records = page_records(frame, rules)
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(page_id#\d+L, 37\)", plan)) == 2
    assert re.search(r"Exchange hashpartitioning\(_own_key#\d+, _salt#\d+, 37\)", plan)
    assert records.count() == 20
