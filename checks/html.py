"""Registered page queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import inputs
from checks import oracle_html as o
from galley.functions import markup, text, urls
from galley.functions.dates import parse_date
from galley.operators import dom
from galley.operators.boilerplate import boilerplate_nodes
from galley.operators.extraction import best_container, candidates, extract, first_container_text, generic_paragraphs, site_texts
from galley.operators.parsing import choose_fallback, fallback_lists, generic_lists, parse
from galley.operators.records import kept_text, page_records, token_at, whole_text
from galley.operators.reports import corpus_report, removed_report
from galley.operators.selectors import attach_site, match_selectors
from galley.plans.articles import article_errors, extract_articles
from galley.sources.pages import split_invalid
from galley.sources.rules import (
    load_site_rules,
    selector_rows,
    site_table,
    supported_domains,
    validate_site_rules,
)


def _pages(spark, sf_dir):
    return inputs.table(spark, sf_dir, "pages")


def _records(source):
    return lambda spark, sf_dir: page_records(source(spark, sf_dir))


def _stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


plain, dated, styled = _records(_pages), _records(inputs.dated_pages), _records(inputs.styled_pages)


def flat_articles(articles: DataFrame) -> DataFrame:
    return articles.select(
        "page_id", "url", "domain", "title", "author", _stamp("publish_date"), "content", "clean_content",
        "word_count", "paragraph_count", "extraction_method", "confidence_score", "extractor_method",
        "extraction_confidence",
    )


def s1_read_pages(spark, sf_dir):
    html = F.expr("CASE page_id % 10 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE html END")
    pages = _pages(spark, sf_dir).withColumn("html", html)
    good, bad = split_invalid(pages, max_chars=5000)
    return good.select("page_id", F.lit("ok").alias("outcome")).unionByName(
        bad.select("page_id", F.col("error_type").alias("outcome"))
    )


def p1_valid_url(spark, sf_dir):
    url = F.expr("CASE page_id % 5 WHEN 0 THEN replace(url, 'http', 'ftp') WHEN 1 THEN replace(url, '://', ':') ELSE url END")
    return _pages(spark, sf_dir).select("page_id", urls.is_valid_url(url).alias("valid"))


def p2_domain(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.domain_of(F.upper("url")).alias("domain"))


def p3_site_key(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.site_key(urls.domain_of(F.col("url"))).alias("site_key"))


def p4_supported_sites(spark, sf_dir):
    sites = site_table(load_site_rules(spark))
    return attach_site(inputs.dated_pages(spark, sf_dir), sites).select("page_id", "supported")


def j1_attach_site(spark, sf_dir):
    sites = site_table(load_site_rules(spark))
    return attach_site(inputs.dated_pages(spark, sf_dir), sites).select("page_id", "domain", "site")


def n1_strip_scripts(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", markup.strip_scripts(F.col("html")).alias("html"))


def n2_tokens(spark, sf_dir):
    return dom.tokenize(_pages(spark, sf_dir)).filter("kind <> 'eof'")


def n3_nodes(spark, sf_dir):
    return dom.node_table(inputs.styled_pages(spark, sf_dir)).select("page_id", "start", "end", "tag")


def n4_attributes(spark, sf_dir):
    nodes = dom.node_attributes(dom.node_table(inputs.styled_pages(spark, sf_dir)))
    return nodes.select("page_id", "start", F.explode("attrs").alias("name", "value"))


def n5_text_runs(spark, sf_dir):
    return dom.text_runs(_pages(spark, sf_dir))


def n6_node_text(spark, sf_dir):
    nodes = F.filter("toks", lambda t: (t.kind == "open") & ~t.gone & t.tag.isin("p", "article", "li"))
    texts = F.transform(
        nodes,
        lambda n: F.struct(
            n.pos.alias("start"),
            n.tag.alias("tag"),
            kept_text(n.pos, n.end).alias("kept"),
            whole_text(n.pos, n.end).alias("whole"),
        ),
    )
    return plain(spark, sf_dir).select("page_id", F.inline(texts))


def j2_selector_matches(spark, sf_dir):
    sites = site_table(load_site_rules(spark))
    placed = attach_site(inputs.dated_pages(spark, sf_dir), sites)
    rows = dom.dom_rows(placed, ("site",))
    return match_selectors(rows, selector_rows(sites)).select("page_id", "field", "priority", "start", "end", "tag")


def j2_custom_selectors(spark, sf_dir):
    """Rules of a user for every second host, through the plan for rules of any number."""
    pages = _pages(spark, sf_dir)
    hosts = pages.select(urls.site_key(urls.domain_of(F.col("url"))).alias("domain")).filter("length(domain) % 2 = 0").distinct()
    custom = hosts.select(
        "domain", F.lit("#nothing, html[lang^='e'] h1").alias("title_selector"), F.lit("body article p").alias("content_selector"),
        F.lit("nav ul li a").alias("author_selector"), F.lit("div.ad, p.a.b, p:first-child").alias("date_selector"),
        F.array(F.lit("main p")).alias("fallback_selectors"),
    )
    sites = site_table(load_site_rules(spark, custom))
    parts = dom.page_parts(pages)
    rows = dom.with_places(dom.dom_rows(attach_site(pages, sites, small=False), ("site",), parts=parts))
    found = match_selectors(rows.filter("site <> '*'"), selector_rows(sites), small=False, parts=parts)
    own = found.filter(F.col("field").isin("title", "content", "author", "date"))
    return own.select("page_id", "field", "priority", "start", "end", "tag")


#: Selectors that ask for parents, siblings, places and what a node is not.
PLACED = {
    "title": "article > h1:first-child, nav + * h1, body > :not(nav) > h1",
    "content": "article > p:nth-child(2n+1), h1 + p, p:nth-last-of-type(-n+2)",
    "author": "ul > li:nth-child(even) > a, li:first-child ~ li:not(:last-child) a, nav li:last-child a[href]",
    "date": "nav ~ footer, div.ad + *, body > :only-of-type, head > meta:first-of-type ~ :not(meta):not([rel])",
}


def j2_child_and_sibling_selectors(spark, sf_dir):
    """Custom rules with combinators and places, for every host."""
    pages = _pages(spark, sf_dir)
    hosts = pages.select(urls.site_key(urls.domain_of(F.col("url"))).alias("domain")).distinct()
    custom = hosts.select(
        "domain", *[F.lit(text).alias(f"{field}_selector") for field, text in PLACED.items()], F.array(F.lit("main > p")).alias("fallback_selectors")
    )
    sites = site_table(load_site_rules(spark, custom))
    parts = dom.page_parts(pages)
    rows = dom.with_places(dom.dom_rows(attach_site(pages, sites, small=False), ("site",), parts=parts))
    found = match_selectors(rows.filter("site <> '*'"), selector_rows(sites), small=False, parts=parts)
    own = found.filter(F.col("field").isin(*PLACED))
    return own.select("page_id", "field", "priority", "start", "end", "tag")


def n3_node_places(spark, sf_dir):
    """Parents and places of all nodes, of well-formed and of styled pages with unclosed ones."""
    rows = dom.with_places(dom.dom_rows(inputs.styled_pages(spark, sf_dir))).filter("place IS NOT NULL")
    return rows.select("page_id", F.col("pos").alias("start"), "place.*")


def j6_removed_reasons(spark, sf_dir):
    rows = extract_articles(inputs.styled_pages(spark, sf_dir))
    return rows.select("page_id", F.array_join("removed_reasons", "|").alias("reasons"))


def j3_boilerplate_nodes(spark, sf_dir):
    return boilerplate_nodes(dom.node_table(inputs.styled_pages(spark, sf_dir))).select(
        "page_id", "start", "end", "reason"
    )


def j4_runs_in_nodes(spark, sf_dir):
    nodes = F.filter("toks", lambda t: t.kind == "open")
    counts = F.transform(
        nodes, lambda n: F.struct(n.pos.alias("start"), (token_at(n.end).n_text - n.n_text).alias("runs"))
    )
    return plain(spark, sf_dir).select("page_id", F.inline(counts))


def j5_drop_boilerplate(spark, sf_dir):
    rows = dom.dom_rows(inputs.styled_pages(spark, sf_dir))
    return rows.filter("kept").select("page_id", "pos", F.col("run").alias("text"))


def a1_candidate_features(spark, sf_dir):
    return styled(spark, sf_dir).select("page_id", F.inline(candidates())).select(
        "page_id", "start", "tag", "content_hits", "words", "paragraphs", "links"
    )


def a2_readability_score(spark, sf_dir):
    return styled(spark, sf_dir).select("page_id", F.inline(candidates())).select("page_id", "start", "score")


def a3_generic_text(spark, sf_dir):
    rows = plain(spark, sf_dir).withColumn("paragraphs", generic_paragraphs())
    joined = F.array_join("paragraphs", "\n\n")
    return rows.select(
        "page_id", F.when(F.size("paragraphs") > 0, joined).otherwise(first_container_text()).alias("text")
    )


def a4_selector_text(spark, sf_dir):
    rows = dated(spark, sf_dir).withColumn("extractor_text", F.array_join(site_texts(), "\n\n"))
    return parse(rows).select("page_id", "extractor_text", F.col("site_content").alias("parser_text"))


def a5_removed_report(spark, sf_dir):
    return removed_report(dom.dom_rows(inputs.styled_pages(spark, sf_dir)))


def w1_best_container(spark, sf_dir):
    rows = styled(spark, sf_dir).withColumn("candidates", candidates())
    return (
        rows.withColumn("best", best_container())
        .filter("best IS NOT NULL")
        .select("page_id", "best.start", "best.tag", "best.score")
    )


def w2_choose_extraction(spark, sf_dir):
    return extract(styled(spark, sf_dir)).select("page_id", "extractor_method", "clean_content")


def p15_extraction_confidence(spark, sf_dir):
    return extract(styled(spark, sf_dir)).select("page_id", "extraction_confidence")


def p16_formatting_info(spark, sf_dir):
    return extract(plain(spark, sf_dir)).select(
        "page_id",
        "formatting.has_paragraphs",
        F.round("formatting.avg_paragraph_length", 6).alias("avg_paragraph_length"),
        "formatting.has_proper_sentences",
    )


def p17_quality_warning(spark, sf_dir):
    return extract(plain(spark, sf_dir)).select("page_id", "warning")


def w3_choose_fallback(spark, sf_dir):
    lists = styled(spark, sf_dir).select("page_id", fallback_lists().alias("l"), generic_lists().alias("g"))
    rows = lists.withColumn("choice", choose_fallback(F.col("l"), F.col("g")))
    return rows.select(
        "page_id",
        "choice.method",
        F.size("choice.paragraphs").alias("n_paragraphs"),
        F.array_join("choice.paragraphs", "\n\n").alias("content"),
    )


def w4_choose_parse(spark, sf_dir):
    return parse(dated(spark, sf_dir)).select(
        "page_id", "extraction_method", F.col("parsed_paragraphs").alias("n_paragraphs")
    )


def p14_parse_confidence(spark, sf_dir):
    return parse(dated(spark, sf_dir)).select(
        "page_id", F.col("site_confidence").alias("confidence"), "confidence_score"
    )


def w5_first_matches(spark, sf_dir):
    return parse(dated(spark, sf_dir)).select("page_id", "title", "author", _stamp("publish_date"))


def p18_parse_date(spark, sf_dir):
    rows = inputs.date_strings(spark, sf_dir).withColumn("parsed", parse_date(F.col("text")))
    return rows.select("o_orderkey", "text", _stamp("parsed"))


def j6_articles(spark, sf_dir):
    return flat_articles(extract_articles(_pages(spark, sf_dir)))


def j6_articles_dated(spark, sf_dir):
    return flat_articles(extract_articles(inputs.dated_pages(spark, sf_dir)))


def j6_articles_styled(spark, sf_dir):
    return flat_articles(extract_articles(inputs.styled_pages(spark, sf_dir)))


def a8_corpus_report(spark, sf_dir):
    return corpus_report(extract_articles(_pages(spark, sf_dir)))


def p20_validate_site_rules(spark, sf_dir):
    return validate_site_rules(inputs.rule_candidates(spark, sf_dir))


def s5_load_site_rules(spark, sf_dir):
    rules = load_site_rules(spark, inputs.rule_candidates(spark, sf_dir).drop("page_id"))
    return rules.select(
        "domain", "title_selector", "content_selector", "author_selector", "date_selector",
        F.array_join("fallback_selectors", "|").alias("fallbacks"),
    )


def p4_supported_domains(spark, sf_dir):
    return supported_domains(load_site_rules(spark, inputs.rule_candidates(spark, sf_dir).drop("page_id")))


def o4_article_errors(spark, sf_dir):
    url = F.expr("CASE WHEN page_id % 5 = 0 THEN replace(url, '://', ':') ELSE url END")
    html = F.expr("CASE page_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE html END")
    pages = _pages(spark, sf_dir).withColumn("url", url).withColumn("html", html)
    return article_errors(pages)


QUERIES = {
    name: f
    for name, f in list(globals().items())
    if callable(f) and getattr(f, "__module__", None) == __name__ and name[0] in "spnjawo" and name[1].isdigit()
}

_D, _S, _P = o.dom(o.DATED), o.dom(o.STYLED), o.dom(o.PLAIN)
_RULES = f"""SELECT page_id, {inputs.RULE_ROWS}, CASE WHEN page_id % 6 = 0 THEN ['main p', '', 'p{{{{'] ELSE ['section p'] END AS fallback_selectors
  FROM (SELECT *, {inputs.RULE_HOST} AS host FROM pages)""".replace("{{", "{")


def _rules_sql() -> str:
    import json

    from galley.sources.rules import BUILT_IN

    rows = []
    for domain, r in BUILT_IN.items():
        fields = [domain, r["title_selector"], r["content_selector"], r["author_selector"], r["date_selector"]]
        rows.append("(" + ", ".join(o.q(x) for x in fields) + ", " + "[" + o.names(r["fallback_selectors"]) + "])")
    built = "(VALUES " + ", ".join(rows) + ") b(domain, title_selector, content_selector, author_selector, date_selector, fallback_selectors)"
    return f"""WITH cand AS ({_RULES}), allr AS (
      SELECT * EXCLUDE page_id, 0 AS rk FROM cand WHERE length(trim(domain)) > 0 AND length(title_selector) > 0 AND length(content_selector) > 0
      UNION ALL SELECT *, 1 AS rk FROM {built}), picked AS (
      SELECT * FROM allr QUALIFY row_number() OVER (PARTITION BY domain ORDER BY rk,
        coalesce(title_selector, ''), content_selector, author_selector NULLS LAST, date_selector NULLS LAST, fallback_selectors) = 1)"""


def _faults_sql() -> str:
    dom_ok = r"^(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)*[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?$"
    pieces = [
        "SELECT domain, 'domain' AS field, 'Domain cannot be empty' AS message, NULL AS value FROM cand WHERE trim(domain) = ''",
        f"SELECT domain, 'domain', 'Invalid domain format', domain FROM cand WHERE trim(domain) <> '' AND domain <> '*' AND NOT regexp_matches(domain, {o.q(dom_ok)})",
        "SELECT domain, 'title_selector', 'Title selector cannot be empty', NULL FROM cand WHERE coalesce(trim(title_selector), '') = ''",
        "SELECT domain, 'content_selector', 'Content selector cannot be empty', NULL FROM cand WHERE coalesce(trim(content_selector), '') = ''",
    ]
    for f in ("title_selector", "content_selector", "author_selector", "date_selector"):
        pieces.append(
            f"SELECT domain, '{f}', 'Invalid CSS selector syntax', {f} FROM cand WHERE length({f}) > 0 AND (trim({f}) = '' OR regexp_matches({f}, '[<>{{}}()]'))"
        )
    step = "(?:[a-zA-Z][a-zA-Z0-9-]*|\\*)?(?:[.#][A-Za-z0-9_-]+)*"
    chain = o.q(f"{step}((\\s+|\\s*[>+~]\\s*){step}){{0,4}}")
    odd = "len(list_filter(string_split({0}, ','), lambda p: trim(p) = '' OR NOT regexp_full_match(trim(p), {1}))) > 0"
    for f in ("title_selector", "content_selector", "author_selector", "date_selector"):
        pieces.append(f"SELECT domain, '{f}', 'Unsupported selector', {f} FROM cand WHERE trim({f}) <> '' AND {odd.format(f, chain)}")
    each = "(SELECT domain, unnest(fallback_selectors) AS s, generate_subscripts(fallback_selectors, 1) - 1 AS i FROM cand)"
    pieces.append(f"SELECT domain, concat('fallback_selectors[', i, ']'), 'Fallback selector cannot be empty', NULL FROM {each} WHERE trim(s) = ''")
    pieces.append(f"SELECT domain, concat('fallback_selectors[', i, ']'), 'Invalid CSS selector syntax', s FROM {each} WHERE trim(s) <> '' AND regexp_matches(s, '[<>{{}}()]')")
    pieces.append(f"SELECT domain, concat('fallback_selectors[', i, ']'), 'Unsupported selector', s FROM {each} WHERE trim(s) <> '' AND {odd.format('s', chain)}")
    return f"WITH cand AS ({_RULES}) " + " UNION ALL ".join(pieces)


_PLACES = """,
lev AS MATERIALIZED (
  SELECT n.*, (SELECT count(*) FROM nd m WHERE m.page_id = n.page_id AND m.kind = 'open' AND m.start < n.start AND m.fin > n.start) AS lvl FROM nd n),
par AS MATERIALIZED (
  SELECT n.*, (SELECT max(m.start) FROM lev m WHERE m.page_id = n.page_id AND m.kind = 'open' AND m.start < n.start AND m.lvl = n.lvl - 1) AS parent FROM lev n),
pl AS MATERIALIZED (
  SELECT *, row_number() OVER c AS idx, count(*) OVER (PARTITION BY page_id, parent) - row_number() OVER c + 1 AS lst,
    row_number() OVER t AS tidx, count(*) OVER (PARTITION BY page_id, parent, tag) - row_number() OVER t + 1 AS tlst
  FROM par WINDOW c AS (PARTITION BY page_id, parent ORDER BY start), t AS (PARTITION BY page_id, parent, tag ORDER BY start))"""


def _placed_sql() -> str:
    """The selectors of PLACED by self joins over parents and ordinals."""

    def kin(outer: str, sign: str, inner: str, test: str) -> str:
        relation = {
            ">": f"{outer}.start = {inner}.parent",
            "+": f"{outer}.parent IS NOT DISTINCT FROM {inner}.parent AND {outer}.idx = {inner}.idx - 1",
            "~": f"{outer}.parent IS NOT DISTINCT FROM {inner}.parent AND {outer}.idx < {inner}.idx",
            " ": f"{outer}.start < {inner}.start AND {inner}.start < {outer}.fin",
        }[sign]
        return f"EXISTS (SELECT 1 FROM pl {outer} WHERE {outer}.page_id = {inner}.page_id AND {relation} AND {test})"

    ad = "list_contains({0}.classes, 'ad')"
    tests = {
        "title": [
            "n.tag = 'h1' AND n.idx = 1 AND " + kin("a", ">", "n", "a.tag = 'article'"),
            "n.tag = 'h1' AND " + kin("a", " ", "n", kin("b", "+", "a", "b.tag = 'nav'")),
            "n.tag = 'h1' AND " + kin("a", ">", "n", "a.tag <> 'nav' AND " + kin("b", ">", "a", "b.tag = 'body'")),
        ],
        "content": [
            "n.tag = 'p' AND n.idx % 2 = 1 AND " + kin("a", ">", "n", "a.tag = 'article'"),
            "n.tag = 'p' AND " + kin("a", "+", "n", "a.tag = 'h1'"),
            "n.tag = 'p' AND n.tlst <= 2",
        ],
        "author": [
            "n.tag = 'a' AND " + kin("a", ">", "n", "a.tag = 'li' AND a.idx % 2 = 0 AND " + kin("b", ">", "a", "b.tag = 'ul'")),
            "n.tag = 'a' AND regexp_matches(n.t, '(?i)\\shref\\b') AND " + kin("a", " ", "n", "a.tag = 'li' AND a.lst = 1 AND " + kin("b", " ", "a", "b.tag = 'nav'")),
        ],
        "date": [
            "n.tag = 'footer' AND " + kin("a", "~", "n", "a.tag = 'nav'"),
            kin("a", "+", "n", f"a.tag = 'div' AND {ad.format('a')}"),
            "n.tidx = 1 AND n.tlst = 1 AND " + kin("a", ">", "n", "a.tag = 'body'"),
            "n.tag <> 'meta' AND NOT regexp_matches(n.t, '(?i)\\srel\\b') AND "
            + kin("a", "~", "n", "a.tag = 'meta' AND a.tidx = 1 AND " + kin("b", ">", "a", "b.tag = 'head'")),
        ],
    }
    pieces = [
        f"SELECT n.page_id, '{field}' AS field, 0 AS priority, n.start, n.fin AS \"end\", n.tag FROM pl n "
        f"WHERE n.kind IN ('open', 'void') AND {test}"
        for field, parts in tests.items()
        for test in parts
    ]
    return f"{_P}{_PLACES} " + " UNION ".join(pieces)


def _custom_sql() -> str:
    """The four custom selectors by nested EXISTS."""

    def inside(inner: str, outer: str, test: str) -> str:
        return (
            f"EXISTS (SELECT 1 FROM nd {outer} WHERE {outer}.page_id = {inner}.page_id AND {outer}.start < {inner}.start "
            f"AND {inner}.start < {outer}.fin AND {test})"
        )

    tests = {
        "title": "n.tag = 'h1' AND " + inside("n", "a", "a.tag = 'html' AND regexp_matches(a.t, ' lang=\"e')"),
        "content": "n.tag = 'p' AND " + inside("n", "a", "a.tag = 'article' AND " + inside("a", "b", "b.tag = 'body'")),
        "author": "n.tag = 'a' AND "
        + inside("n", "a", "a.tag = 'li' AND " + inside("a", "b", "b.tag = 'ul' AND " + inside("b", "c", "c.tag = 'nav'"))),
        "date": "(n.tag = 'div' AND regexp_matches(n.t, 'class=\"ad\"') OR n.tag = 'p' AND n.idx = 1)",
    }
    pieces = [
        f"SELECT n.page_id, '{field}' AS field, 0 AS priority, n.start, n.fin AS \"end\", n.tag FROM pl n JOIN pg USING (page_id) "
        f"WHERE length(regexp_replace(domain, '^www\\.', '')) % 2 = 0 AND n.kind IN ('open', 'void') AND {test}"
        for field, test in tests.items()
    ]
    return f"{_P}{_PLACES} " + " UNION ALL ".join(pieces)


_REMOVED = f"""{_S} SELECT page_id, reason, count(*) AS n FROM (
        SELECT page_id, reason FROM boiler b WHERE reason NOT LIKE 'pattern%' OR NOT EXISTS (
          SELECT 1 FROM boiler c WHERE c.page_id = b.page_id AND c.reason NOT LIKE 'pattern%' AND c.start < b.start AND b.start < c.fin)
        UNION ALL SELECT page_id, CASE WHEN t LIKE '<!--%' THEN 'comment' ELSE concat('script_style:', lower(regexp_extract(t, '^<([a-zA-Z]+)', 1))) END
          FROM tk WHERE kind = 'skip' AND (t LIKE '<!--%' OR regexp_matches(t, '(?i)^<(script|style)'))) GROUP BY ALL"""

ORACLE = {
    "s1_read_pages": "SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'NULL_INPUT' WHEN page_id % 10 = 1 THEN 'empty_input' "
    "WHEN length(html) > 5000 THEN 'CONTENT_TOO_LONG' ELSE 'ok' END AS outcome FROM pages",
    "p1_valid_url": "SELECT page_id, page_id % 5 > 1 AS valid FROM pages",
    "p2_domain": f"SELECT page_id, {o.DOMAIN} AS domain FROM pages",
    "p3_site_key": f"SELECT page_id, regexp_replace({o.DOMAIN}, '^www\\.', '') AS site_key FROM pages",
    "p4_supported_sites": "SELECT page_id, page_id % 4 < 2 AS supported FROM pages",
    "p4_supported_domains": _rules_sql() + " SELECT domain FROM picked WHERE domain <> '*'",
    "s5_load_site_rules": _rules_sql()
    + " SELECT domain, title_selector, content_selector, author_selector, date_selector, array_to_string(fallback_selectors, '|') AS fallbacks FROM picked",
    "p20_validate_site_rules": _faults_sql(),
    "j1_attach_site": f"{_D} SELECT page_id, domain, site FROM pg",
    "n1_strip_scripts": f"SELECT page_id, regexp_replace(html, {o.q('(?is)' + '|'.join((o.COMMENT, o.SCRIPT, o.STYLE, o.NOSCRIPT)))}, '', 'g') AS html FROM pages",
    "n2_tokens": f"{_P} SELECT page_id, pos, kind, tag, t FROM tk WHERE kind <> 'eof'",
    "n3_nodes": f'{_S} SELECT page_id, start, fin AS "end", tag FROM nd',
    "n4_attributes": f"""{_S}, al AS (SELECT page_id, start, unnest(regexp_extract_all(
        regexp_replace(t, '^<[a-zA-Z][^\\s/>]*', ''), '[^\\s"''>/=]+\\s*=\\s*(?:"[^"]*"|''[^'']*''|[^\\s"''>]+)')) AS a FROM nd
        WHERE regexp_matches(t, '=')),
      other AS (SELECT page_id, start, 'disabled' AS name, '' AS value FROM nd WHERE false)
      SELECT page_id, start, lower(split_part(a, '=', 1)) AS name,
        {o.decode("regexp_replace(regexp_replace(a, '^[^=]*=', ''), '^[\"'']|[\"'']$', '', 'g')")} AS value FROM al""",
    "n5_text_runs": f"{_P} SELECT page_id, pos, text FROM runs",
    "n6_node_text": f"""{_P}, pn AS (SELECT * FROM live WHERE kind = 'open' AND tag IN ('p','article','li'))
      SELECT k.page_id, k.start, k.tag, k.text AS kept, w.text AS whole FROM ({o.kept_text('pn')}) k JOIN ({o.whole_text('pn')}) w
        ON w.page_id = k.page_id AND w.start = k.start""",
    "j2_selector_matches": f'{_D}{o.matches()} SELECT page_id, field, priority, start, fin AS "end", tag FROM mt',
    "j2_custom_selectors": _custom_sql(),
    "j2_child_and_sibling_selectors": _placed_sql(),
    "n3_node_places": f"{_S}{_PLACES} SELECT page_id, start, parent, CAST(idx AS INT) AS nth, CAST(lst AS INT) AS nth_last, CAST(tidx AS INT) AS nth_type, CAST(tlst AS INT) AS nth_last_type FROM pl WHERE kind IN ('open', 'void')",
    "j3_boilerplate_nodes": f'{_S} SELECT page_id, start, fin AS "end", reason FROM boiler',
    "j4_runs_in_nodes": f"""{_P} SELECT n.page_id, n.start, count(r.pos) AS runs FROM nd n LEFT JOIN runs r
        ON r.page_id = n.page_id AND n.start < r.pos AND r.pos < n.fin WHERE n.kind = 'open' GROUP BY ALL""",
    "j5_drop_boilerplate": f"{_S} SELECT page_id, pos, text FROM keep",
    "a1_candidate_features": f"{_S}{o.matches()}{o.extraction()} SELECT page_id, start, tag, content_hits, words, paragraphs, links FROM ft",
    "a2_readability_score": f"{_S}{o.matches()}{o.extraction()} SELECT page_id, start, score FROM ft",
    "a3_generic_text": f"{_P}{o.matches()}{o.extraction()} SELECT pg.page_id, coalesce(gp.text, gc.text, '') AS text FROM pg LEFT JOIN gp USING (page_id) LEFT JOIN gc USING (page_id)",
    "a4_selector_text": f"{o.articles_ctes(o.DATED)} SELECT sp.page_id, coalesce(st.text, '') AS extractor_text, sp.content AS parser_text FROM sp LEFT JOIN st USING (page_id)",
    "a5_removed_report": _REMOVED,
    "j6_removed_reasons": f"SELECT page_id, coalesce(reasons, '') AS reasons FROM pages LEFT JOIN (SELECT page_id, string_agg(reason, '|' ORDER BY reason) AS reasons FROM ({_REMOVED}) GROUP BY ALL) USING (page_id)",
    "w1_best_container": f"{_S}{o.matches()}{o.extraction()} SELECT page_id, start, tag, score FROM best",
    "w2_choose_extraction": f"{_S}{o.matches()}{o.extraction()} SELECT page_id, extractor_method, clean_content FROM ex",
    "p15_extraction_confidence": f"{_S}{o.matches()}{o.extraction()} SELECT page_id, extraction_confidence FROM ex",
    "p16_formatting_info": f"{_P}{o.matches()}{o.extraction()} SELECT page_id, paragraph_count > 1 AS has_paragraphs, round(word_count / greatest(paragraph_count, 1), 6) AS avg_paragraph_length, regexp_matches(clean_content, '[.!?]') AS has_proper_sentences FROM ex",
    "p17_quality_warning": f"{_P}{o.matches()}{o.extraction()} SELECT page_id, CASE WHEN extractor_method = 'generic_fallback' AND extraction_confidence < 0.3 THEN 'Low confidence extraction - content quality may be poor' END AS warning FROM ex",
    "w3_choose_fallback": f"{o.articles_ctes(o.STYLED)} SELECT page_id, method, n_paragraphs, content FROM fb",
    "w4_choose_parse": f"{o.articles_ctes(o.DATED)} SELECT page_id, method AS extraction_method, n_paragraphs FROM pr",
    "p14_parse_confidence": f"{o.articles_ctes(o.DATED)} SELECT page_id, sp.confidence, pr.confidence AS confidence_score FROM sp JOIN pr USING (page_id)",
    "w5_first_matches": f"{o.articles_ctes(o.DATED)} SELECT page_id, title, author, strftime(publish_date, {o.STAMP}) AS publish_date FROM pr",
    "p18_parse_date": f"""SELECT o_orderkey, text, strftime({o.parse_date('text')}, {o.STAMP}) AS parsed FROM (
        SELECT o_orderkey, {inputs.dialect(inputs.shown_date('day', 'o_orderkey', inputs.DATE_STRINGS_SPOIL), 'duckdb')} AS text
        FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders))""",
    "j6_articles": f"{o.articles_ctes(o.PLAIN)} {o.ARTICLES}",
    "j6_articles_dated": f"{o.articles_ctes(o.DATED)} {o.ARTICLES}",
    "j6_articles_styled": f"{o.articles_ctes(o.STYLED)} {o.ARTICLES}",
    "a8_corpus_report": f"""{o.articles_ctes(o.PLAIN)} SELECT e.domain, e.extractor_method AS method, count(*) AS articles,
        CAST(sum(e.word_count) AS BIGINT) AS words, round(avg(p.confidence), 6) AS mean_confidence
        FROM ex e JOIN pr p USING (page_id) GROUP BY ROLLUP (e.domain, e.extractor_method)""",
    "o4_article_errors": """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN replace(url, '://', ':') ELSE url END AS url,
        CASE WHEN page_id % 5 = 0 THEN 'SCRAPING_ERROR' WHEN page_id % 7 = 0 THEN 'NULL_INPUT' ELSE 'empty_input' END AS error_type,
        CASE WHEN page_id % 5 = 0 THEN 'Invalid URL format' WHEN page_id % 7 = 0 THEN 'HTML input is None' ELSE 'Empty HTML input' END AS message,
        'scraping' AS step FROM pages WHERE page_id % 5 = 0 OR page_id % 7 < 2""",
}
