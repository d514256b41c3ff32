import random

from galley.llm.registry import URL_RULES
from galley.llm.url_filters import judge_urls

PAGES = "page_id long, url string, html string, host string, verdict string, _row string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = rest[:cut].translate({c: c + 32 for c in range(65, 91)})
    tail = rest[cut:]
    return host, tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]


def brute(url, rules):
    host, path = parts(url)
    fits = [
        (len(h + p), len(h), v, h + p) for h, p, v in rules if None not in (h, p, v)
        and (host == h or host.endswith("." + h)) and path.startswith(p) and host
    ]
    best = max(fits, default=(0, 0, "allow", None))
    return host, path, best[3], best[2]


def odd_pages(spark):
    draw = random.Random(3)
    hosts = ["example.com", "www.Example.com", "m.example.net", "net", "com", "a.b.c.example.org", "x..y.com", ""]
    paths = ["", "/", "/en/", "/en/a", "/es/1?q=/en/", "/fr", "/fr/#x", "//en//", "/en/a/b.html", "?x/y", "/é/ü\nz"]
    urls = [f"{draw.choice(['http', 'https', ''])}://{draw.choice(hosts)}{draw.choice(paths)}" for _ in range(300)]
    urls += [None, "", "no scheme", "://", "a://b://c/en/", "http://example.com", "HTTP://NET/fr/x" + "/y" * 3_000]
    rows = [(k if k % 7 else None, u, "h", "x", "y", "z") for k, u in enumerate(urls + urls[:20])]
    return spark.createDataFrame(rows, PAGES), [(r[0], r[1]) for r in rows]


def test_listed_rules(spark):
    frame, rows = odd_pages(spark)
    found = [tuple(r) for r in judge_urls(frame, URL_RULES).collect()]
    expected = [(page, *brute(url, URL_RULES)) for page, url in rows]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert judge_urls(frame.limit(0), URL_RULES).count() == 0


def test_rule_frame_of_any_size(spark):
    frame, rows = odd_pages(spark)
    rules = [*URL_RULES, ("com", "", "block"), ("example.com", "/en/a", "block"), ("example.com", "/e", "allow"),
             ("com", "", "block"), ("com", "", "allow"), (None, "/", "block"), ("org", None, "block")]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    expected = [(page, *brute(url, rules)) for page, url in rows]
    assert sorted((tuple(r) for r in judge_urls(frame, table).collect()), key=str) == sorted(expected, key=str)
    none = judge_urls(frame, table.limit(0)).select("rule", "verdict").distinct().collect()
    assert [tuple(r) for r in none] == [(None, "allow")]


def test_long_urls(spark):
    urls = ["http://a.example.com/en" + "/x" * 500_000, "http://" + "a." * 500_000 + "net/fr/" + "y" * 1_000_000, "http://net/" + "/" * 1_000_000]
    frame = spark.createDataFrame([(k, u, "", "", "", "") for k, u in enumerate(urls)], PAGES)
    rows = {r.page_id: tuple(r) for r in judge_urls(frame, URL_RULES).collect()}
    assert [rows[k] for k in range(3)] == [(k, *brute(u, URL_RULES)) for k, u in enumerate(urls)]


def test_no_python_in_the_plan(spark):
    plan = judge_urls(odd_pages(spark)[0], URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
