"""SQL for the page operators. Containment is written as plain interval joins here, node by node,
while the Spark side answers it with running windows: two different ways to the same rows."""

from __future__ import annotations

from checks import inputs
from galley.functions.dates import DATE_FORMATS
from galley.functions.markup import VOID_TAGS
from galley.operators.boilerplate import BOILERPLATE_PATTERNS, BOILERPLATE_TAGS
from galley.operators.dom import P_CLOSERS
from galley.operators.records import CONTENT_PATTERNS
from galley.sources.rules import BUILT_IN, GENERIC_FIELDS

WS = r"[\s\x0B\x1C-\x1F\x{85}\pZ]"
WORD = r"[^\s\x0B\x1C-\x1F\x{85}\pZ]+"
COMMENT = r"<!--.*?(?:-->|\z)"
SCRIPT = r"<script\b.*?(?:</script[^>]*>|\z)"
STYLE = r"<style\b.*?(?:</style[^>]*>|\z)"
NOSCRIPT = r"<noscript\b.*?(?:</noscript[^>]*>|\z)"
TAG = r"""</?[a-z][^<>"']*(?:"[^"<]*"[^<>"']*|'[^'<]*'[^<>"']*)*>"""
TOKEN = f"(?is){COMMENT}|{SCRIPT}|{STYLE}|{TAG}|</?[a-z][^>]*>|<[!?/][^>]*>|<?[^<]+|<"


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def names(values) -> str:
    return ", ".join(q(v) for v in values)


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, {q(WORD)}))"


def parts(x: str) -> str:
    return f"(len(regexp_extract_all({x}, '[.!?]+')) + 1)"


def letters(x: str) -> str:
    return f"length(regexp_replace({x}, {q(WS)}, '', 'g'))"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(WS + '+')}, ' ', 'g'))"


def clean_text(x: str) -> str:
    x = f"regexp_replace({x}, {q(WS + '+')}, ' ', 'g')"
    x = f"regexp_replace({x}, '(?i)^(Advertisement|Sponsored|Related:|Share:|Follow:|Subscribe:)', '')"
    x = f"regexp_replace({x}, '(?is)(Click here|Read more|Continue reading).*', '')"
    x = f"regexp_replace({x}, '(?i)^ *(By|Author:|Written by) +', '')"
    return f"trim(regexp_replace({x}, '(?is) *(Share on|Follow us|Subscribe to).*', ''))"


def clean_block(x: str) -> str:
    return f"regexp_replace({collapse(x)}, '(?i)^(Advertisement|Sponsored|Related:|Share:|Follow:)', '')"


def good(x: str) -> str:
    w = words(x)
    return (
        f"coalesce({w} >= 50 AND {parts(x)} >= 3 AND {letters(x)} >= 3 * {w} "
        f"AND {letters(x)} <= 15 * {w}, false)"
    )


def attr(name: str) -> str:
    pattern = rf"""(?i)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    group = [f"regexp_extract(t, {q(pattern)}, {i})" for i in (1, 2, 3)]
    return f"concat({', '.join(group)})"


def decode(x: str) -> str:
    for entity, char in (
        ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"),
    ):
        x = f"replace({x}, {q(entity)}, {q(char)})"
    return x


PLAIN = "SELECT page_id, url, html FROM pages"
DATED = (
    f"SELECT page_id, {inputs.DATED_URL} AS url, {inputs.DATED_HTML} AS html FROM (SELECT *, "
    f"{inputs.dialect(inputs.shown_date('day', 'page_id', inputs.PAGE_SPOIL), 'duckdb')} AS shown FROM "
    f"(SELECT *, {inputs.PAGE_DAY_SQL} AS day FROM pages))"
)
STYLED = f"SELECT page_id, url, {inputs.STYLED_HTML} AS html FROM pages"

AUTHORITY = "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"
DOMAIN = f"lower(regexp_extract(url, '{AUTHORITY}', 1))"


def dom(source: str) -> str:
    """CTEs: src, tk (tokens), nd (nodes with ends), boiler, keep (kept runs), runs, pg (site)."""
    vd, boil = names(VOID_TAGS), "|".join(BOILERPLATE_PATTERNS)
    hits = " + ".join(f"CASE WHEN contains(ci, {q(p)}) THEN 1 ELSE 0 END" for p in CONTENT_PATTERNS)
    sites = names(d for d in BUILT_IN if d != "*" and not d.startswith("www."))
    return f"""WITH src AS MATERIALIZED ({source}),
tk AS MATERIALIZED (
  SELECT *, CASE WHEN kind IN ('open','close','void')
                 THEN lower(regexp_extract(t, '^</?([a-zA-Z][^\\s/>]*)', 1)) END AS tag FROM (
  SELECT *, CASE WHEN t = '' THEN 'eof'
      WHEN t LIKE '<!%' OR t LIKE '<?%' OR regexp_matches(t, '(?i)^<(script|style)\\b') THEN 'skip'
      WHEN regexp_matches(t, '^</[a-zA-Z]') AND t LIKE '%>' THEN 'close'
      WHEN regexp_matches(t, '^<[a-zA-Z]') AND t LIKE '%>' THEN
        CASE WHEN t LIKE '%/>' OR lower(regexp_extract(t, '^<([a-zA-Z][^\\s/>]*)', 1)) IN ({vd})
             THEN 'void' ELSE 'open' END
      WHEN t LIKE '</%' THEN 'skip' ELSE 'text' END AS kind
  FROM (SELECT page_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS t FROM (
    SELECT page_id, list_append(regexp_extract_all(
      regexp_replace(html, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), {q(TOKEN)}), '') AS l
    FROM src WHERE html IS NOT NULL)))),
dep AS MATERIALIZED (
  SELECT page_id, pos, kind, tag, sum(CASE kind WHEN 'open' THEN 1 ELSE -1 END)
    OVER (PARTITION BY page_id, tag ORDER BY pos) AS d FROM tk WHERE kind IN ('open','close')),
own AS MATERIALIZED (
  SELECT o.page_id, o.pos AS start, o.tag, min(c.pos) AS fin FROM dep o LEFT JOIN dep c
    ON c.page_id = o.page_id AND c.tag = o.tag AND c.kind = 'close' AND c.pos > o.pos AND c.d = o.d - 1
  WHERE o.kind = 'open' GROUP BY ALL),
eof AS (SELECT page_id, max(pos) AS eof FROM tk GROUP BY ALL),
loose AS (
  SELECT u.page_id, u.start, min(m.fin) AS fin FROM own u JOIN own m
    ON m.page_id = u.page_id AND m.start < u.start AND u.start < m.fin AND m.tag <> 'p'
  WHERE u.fin IS NULL GROUP BY ALL),
pend AS (
  SELECT p.page_id, p.pos AS start, min(e.pos) AS fin FROM tk p JOIN tk e
    ON e.page_id = p.page_id AND e.pos > p.pos
   AND ((e.tag = 'p' AND e.kind IN ('open','close')) OR (e.kind = 'close' AND e.tag IN ({names(P_CLOSERS)})))
  WHERE p.kind = 'open' AND p.tag = 'p' GROUP BY ALL),
nd AS MATERIALIZED (
  SELECT *, {hits} AS content_hits FROM (
  SELECT *, lower(concat(array_to_string(classes, ' '), ' ', id)) AS ci FROM (
  SELECT t.page_id, t.pos AS start, t.kind, t.tag, t.t,
    CASE WHEN t.kind = 'void' THEN t.pos WHEN t.tag = 'p' THEN coalesce(p.fin, eof)
         ELSE coalesce(o.fin, l.fin, eof) END AS fin,
    {decode(attr('class'))} AS cls, regexp_extract_all({decode(attr('class'))}, '[^\\s]+') AS classes,
    {decode(attr('id'))} AS id, replace(lower({attr('style')}), ' ', '') AS style,
    {attr('datetime')} AS datetime, {attr('data-ad')} AS dad, {attr('data-widget')} AS dwid,
    {attr('rel')} AS rel, {attr('data-gu-name')} AS gu
  FROM tk t JOIN eof USING (page_id)
  LEFT JOIN own o ON o.page_id = t.page_id AND o.start = t.pos
  LEFT JOIN loose l ON l.page_id = t.page_id AND l.start = t.pos
  LEFT JOIN pend p ON p.page_id = t.page_id AND p.start = t.pos
  WHERE t.kind IN ('open','void')))),
boiler AS MATERIALIZED (
  SELECT page_id, start, fin, tag, CASE WHEN tag IN ('script','style','noscript') THEN concat('script_style:', tag)
      WHEN tag IN ({names(BOILERPLATE_TAGS)}) THEN concat('tag:', tag) ELSE concat('pattern:', tag) END AS reason
  FROM nd WHERE tag IN ({names(BOILERPLATE_TAGS)}) OR regexp_matches(ci, '{boil}') OR dad <> '' OR dwid <> ''
     OR contains(style, 'display:none') OR contains(style, 'visibility:hidden')),
runs AS MATERIALIZED (SELECT page_id, pos, {decode('t')} AS text FROM tk WHERE kind = 'text'),
keep AS MATERIALIZED (
  SELECT * FROM runs r WHERE regexp_matches(text, {q(WORD)}) AND NOT EXISTS (
    SELECT 1 FROM boiler b WHERE b.page_id = r.page_id AND b.start < r.pos AND r.pos < b.fin)),
live AS MATERIALIZED (
  SELECT * FROM nd n WHERE NOT EXISTS (
    SELECT 1 FROM boiler b WHERE b.page_id = n.page_id AND b.start <= n.start
      AND (n.start < b.fin OR n.start = b.start))),
pg AS MATERIALIZED (
  SELECT page_id, url, {DOMAIN} AS domain,
    CASE WHEN regexp_replace({DOMAIN}, '^www\\.', '') IN ({sites})
         THEN regexp_replace({DOMAIN}, '^www\\.', '') ELSE '*' END AS site FROM src WHERE html IS NOT NULL)"""


def kept_text(nodes: str) -> str:
    """Select adding ``text``, the cleaned kept text, to every row of ``nodes`` (page_id, start, fin)."""
    return (
        f"SELECT n.*, {clean_text('coalesce(j.text, chr(32))')} AS text FROM {nodes} n LEFT JOIN ("
        f"SELECT n.page_id, n.start, string_agg(k.text, ' ' ORDER BY k.pos) AS text FROM "
        f"(SELECT DISTINCT page_id, start, fin FROM {nodes}) n JOIN keep k "
        f"ON k.page_id = n.page_id AND n.start < k.pos AND k.pos < n.fin GROUP BY ALL) j "
        f"ON j.page_id = n.page_id AND j.start = n.start"
    )


def whole_text(nodes: str) -> str:
    return (
        f"SELECT n.*, {clean_block('coalesce(j.text, chr(32))')} AS text FROM {nodes} n LEFT JOIN ("
        f"SELECT n.page_id, n.start, string_agg(k.text, '' ORDER BY k.pos) AS text FROM "
        f"(SELECT DISTINCT page_id, start, fin FROM {nodes}) n JOIN runs k "
        f"ON k.page_id = n.page_id AND n.start < k.pos AND k.pos < n.fin GROUP BY ALL) j "
        f"ON j.page_id = n.page_id AND j.start = n.start"
    )


def _test(selector: str, alias: str) -> str:
    """A simple selector as a SQL condition on a node alias."""
    head, _, bracket = selector.partition("[")
    tag, _, cls = head.partition(".")
    tests = []
    if tag:
        tests.append(f"{alias}.tag = {q(tag)}")
    if cls:
        tests.append(f"list_contains({alias}.classes, {q(cls)})")
    if bracket:
        body = bracket.rstrip("]")
        column = {"class": "cls", "rel": "rel", "data-gu-name": "gu", "datetime": "datetime"}
        if "*=" in body:
            name, value = body.split("*=")
            tests.append(f"contains({alias}.{column[name]}, {q(value.strip(chr(39)))})")
        elif "=" in body:
            name, value = body.split("=")
            tests.append(f"{alias}.{column[name]} = {q(value.strip(chr(39)))}")
        else:
            tests.append(f"regexp_matches({alias}.t, '(?i)\\s{body}\\b')")
    return " AND ".join(tests)


def matches() -> str:
    """CTE ``mt``: distinct node matches per page, field and priority."""
    pieces = []
    sites = {d: r for d, r in BUILT_IN.items() if not d.startswith("www.")}
    for site, rule in sites.items():
        fields = {n: [rule[f"{n}_selector"]] for n in ("title", "content", "author", "date")}
        fields |= {"fallback": rule["fallback_selectors"], **GENERIC_FIELDS}
        for field, selectors in fields.items():
            for i, selector in enumerate(selectors):
                for alternative in selector.split(","):
                    steps = alternative.split()
                    where = f"pg.site = {q(site)} AND {_test(steps[-1], 'n')}"
                    if len(steps) == 2:
                        where += (
                            " AND EXISTS (SELECT 1 FROM nd a WHERE a.page_id = n.page_id AND a.start < n.start "
                            f"AND n.start < a.fin AND {_test(steps[0], 'a')})"
                        )
                    pieces.append(
                        f"SELECT n.page_id, {q(field)} AS field, {i} AS priority, n.start, n.fin, n.tag, n.datetime "
                        f"FROM nd n JOIN pg USING (page_id) WHERE {where}"
                    )
    return ",\nmt AS MATERIALIZED (" + "\nUNION ".join(pieces) + ")"


def parse_date(x: str) -> str:
    """The accepted date formats in order, as a timestamp in UTC."""
    x = collapse(x)
    f = {
        "yyyy-M-d'T'H:m:sXX": f"(try_strptime(replace({x}, 'Z', '+0000'), '%Y-%m-%dT%H:%M:%S%z') AT TIME ZONE 'UTC')",
        "yyyy-M-d H:m:s": f"try_strptime({x}, '%Y-%m-%d %H:%M:%S')",
        "yyyy-M-d": f"try_strptime({x}, '%Y-%m-%d')",
        "d/M/yyyy": f"try_strptime({x}, '%d/%m/%Y')",
        "M/d/yyyy": f"try_strptime({x}, '%m/%d/%Y')",
        "MMMM d, yyyy": f"try_strptime({x}, '%B %d, %Y')",
        "d MMMM yyyy": f"try_strptime({x}, '%d %B %Y')",
    }
    return f"coalesce({', '.join(f'CAST({f[p]} AS TIMESTAMP)' for _, p in DATE_FORMATS)})"


STAMP = "'%Y-%m-%d %H:%M:%S'"


def extraction() -> str:
    """CTEs from features to the chosen extraction: ft, best, st, rt, gt, ex."""
    site_nodes = (
        "(SELECT DISTINCT m.page_id, m.start, m.fin FROM mt m JOIN live v ON v.page_id = m.page_id "
        "AND v.start = m.start WHERE m.field = 'content')"
    )
    c = "clean_content"
    return f""",
ft AS MATERIALIZED (
  SELECT *, greatest(content_hits * 10.0
      + CASE WHEN words > 100 THEN 20 WHEN words > 50 THEN 10 WHEN words > 20 THEN 5 ELSE 0 END
      + CASE WHEN words > 0 AND paragraphs > 3 THEN 15 WHEN words > 0 AND paragraphs > 1 THEN 5 ELSE 0 END
      - CASE WHEN links > 10 THEN 10 ELSE 0 END, 0)::DOUBLE AS score,
    list_position(['article','main','section','div'], tag) AS tag_rank FROM (
  SELECT n.page_id, n.start, n.fin, n.tag, n.content_hits,
    (SELECT CASE WHEN count(*) = 0 THEN 0 ELSE {words(f"string_agg(regexp_replace(k.text, {q('^' + WS + '+|' + WS + '+$')}, '', 'g'), '' ORDER BY k.pos)")} END
       FROM keep k WHERE k.page_id = n.page_id AND n.start < k.pos AND k.pos < n.fin) AS words,
    (SELECT count(*) FROM live p WHERE p.page_id = n.page_id AND p.tag = 'p' AND n.start < p.start AND p.start < n.fin) AS paragraphs,
    (SELECT count(*) FROM live p WHERE p.page_id = n.page_id AND p.tag = 'a' AND p.kind = 'open' AND n.start < p.start AND p.start < n.fin) AS links
  FROM live n WHERE n.kind = 'open' AND n.tag IN ('article','main','section','div'))),
best AS MATERIALIZED (
  SELECT * FROM ft WHERE score > 0
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, tag_rank, start) = 1),
st AS (SELECT page_id, string_agg(text, chr(10) || chr(10) ORDER BY start) AS text
       FROM ({kept_text(site_nodes)}) WHERE text <> '' GROUP BY ALL),
rt AS ({kept_text('best')}),
gp AS (SELECT page_id, string_agg(text, chr(10) || chr(10) ORDER BY start) AS text
       FROM ({kept_text("(SELECT * FROM live WHERE tag = 'p' AND kind = 'open')")}) WHERE {words('text')} > 10 GROUP BY ALL),
gc AS (SELECT page_id, text FROM ({kept_text("(SELECT * FROM live WHERE kind = 'open' AND tag IN ('div','section','article'))")})
       WHERE {words('text')} > 20
       QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY list_position(['div','section','article'], tag), start) = 1),
ex AS MATERIALIZED (
  SELECT *, CASE WHEN {c} = '' THEN 0.0 ELSE round(greatest(0.0, least(1.0,
      CASE extractor_method WHEN 'site_specific' THEN 0.8 WHEN 'readability' THEN 0.6 ELSE 0.4 END::DOUBLE
      + CASE WHEN word_count > 200 THEN 0.2 WHEN word_count > 100 THEN 0.1 WHEN word_count < 50 THEN -0.2 ELSE 0 END::DOUBLE
      + CASE WHEN {parts(c)} > 5 THEN 0.1 ELSE 0 END::DOUBLE
      + CASE WHEN len(string_split({c}, chr(10) || chr(10))) > 2 THEN 0.1 ELSE 0 END::DOUBLE)), 6) END AS extraction_confidence
  FROM (SELECT *, {words(c)} AS word_count,
      len(list_filter(string_split({c}, chr(10) || chr(10)), lambda p: regexp_matches(p, {q(WORD)}))) AS paragraph_count
    FROM (SELECT pg.page_id, pg.url, pg.domain, pg.site,
        CASE WHEN {good('st.text')} THEN st.text WHEN {good('rt.text')} THEN rt.text
             ELSE coalesce(gp.text, gc.text, '') END AS {c},
        CASE WHEN {good('st.text')} THEN 'site_specific' WHEN {good('rt.text')} THEN 'readability'
             ELSE 'generic_fallback' END AS extractor_method
      FROM pg LEFT JOIN st USING (page_id) LEFT JOIN rt USING (page_id) LEFT JOIN gp USING (page_id)
      LEFT JOIN gc USING (page_id))))"""


def parsing() -> str:
    """CTEs of the parser: wt (texts of matches), site parse, fallback parse, pr (the choice)."""
    shown = "CASE WHEN datetime <> '' THEN datetime ELSE text END"

    def conf(words_: str, factor: str) -> str:
        return (
            "round(round(least(CASE WHEN length(title) > 10 THEN 0.25 ELSE 0 END::DOUBLE + CASE WHEN content <> '' THEN "
            f"CASE WHEN {words_} > 100 THEN 0.5 WHEN {words_} > 50 THEN 0.3 WHEN {words_} > 20 THEN 0.1 ELSE 0 END "
            "ELSE 0 END::DOUBLE + CASE WHEN author <> '' THEN 0.15 ELSE 0 END::DOUBLE "
            f"+ CASE WHEN publish_date IS NOT NULL THEN 0.1 ELSE 0 END::DOUBLE, 1.0), 6) * {factor}, 6)"
        )

    def fields(title: str, author: str, date: str) -> str:
        return f"""
  (SELECT min_by(text, row(priority, start)) FROM wt WHERE wt.page_id = pg.page_id AND field = '{title}' AND length(text) > 10) AS title,
  (SELECT min_by(text, row(priority, start)) FROM wt WHERE wt.page_id = pg.page_id AND field = '{author}' AND length(text) BETWEEN 1 AND 99) AS author,
  {date} AS publish_date"""

    one_date = (
        f"(SELECT min_by({parse_date(shown)}, row(priority, start)) FROM wt WHERE wt.page_id = pg.page_id "
        f"AND field = 'date' AND length({shown}) > 0)"
    )
    any_date = (
        "(SELECT min_by(d, priority) FROM (SELECT priority, " + parse_date(shown) + " AS d FROM wt "
        f"WHERE wt.page_id = pg.page_id AND field = 'g_date' AND length({shown}) > 0 "
        "QUALIFY row_number() OVER (PARTITION BY priority ORDER BY start) = 1) WHERE d IS NOT NULL)"
    )
    any_date = "gd.d"
    last = " ".join(
        f"WHEN {q(d)} THEN {len(r['fallback_selectors']) - 1}" for d, r in BUILT_IN.items() if not d.startswith("www.")
    )
    method = " ".join(
        f"WHEN site = {q(d)} AND priority = {i} THEN {q('fallback_' + s.replace(' ', '_'))}"
        for d, r in BUILT_IN.items() if not d.startswith("www.") for i, s in enumerate(r["fallback_selectors"])
    )
    return f""",
wt AS MATERIALIZED ({whole_text('mt')}),
pl AS MATERIALIZED (
  SELECT page_id, field, priority, count(*) AS n, string_agg(text, chr(10) || chr(10) ORDER BY start) AS content
  FROM wt WHERE field IN ('content','fallback','g_content') AND {words('text')} > 5 GROUP BY ALL),
gd AS MATERIALIZED (
  SELECT page_id, min_by(d, priority) AS d FROM (
    SELECT page_id, priority, {parse_date(shown)} AS d FROM wt WHERE field = 'g_date' AND length({shown}) > 0
    QUALIFY row_number() OVER (PARTITION BY page_id, priority ORDER BY start) = 1) WHERE d IS NOT NULL GROUP BY ALL),
fb AS MATERIALIZED (
  SELECT page_id, coalesce(rich.content, lst.content, gen.content, '') AS content,
    coalesce(rich.n, lst.n, gen.n, 0) AS n_paragraphs,
    CASE WHEN rich.content IS NOT NULL THEN rich.method WHEN lst.content IS NOT NULL THEN 'generic_fallback'
         ELSE 'generic_extraction' END AS method
  FROM pg
  LEFT JOIN (SELECT page_id, content, n, CASE {method} END AS method FROM pl JOIN pg USING (page_id) WHERE field = 'fallback' AND n > 2
             QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY priority) = 1) rich USING (page_id)
  LEFT JOIN (SELECT page_id, content, n FROM pl JOIN pg USING (page_id)
             WHERE field = 'fallback' AND priority = CASE site {last} END) lst USING (page_id)
  LEFT JOIN (SELECT page_id, content, n FROM pl WHERE field = 'g_content' AND n > 2
             QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY priority) = 1) gen USING (page_id)),
sp AS MATERIALIZED (
  SELECT *, {conf(words('content'), '1.0')} AS confidence FROM (
    SELECT pg.page_id, coalesce(pl.content, '') AS content, coalesce(pl.n, 0) AS n_paragraphs, {fields('title', 'author', one_date)},
      concat('site_specific_', pg.site) AS method
    FROM pg LEFT JOIN pl ON pl.page_id = pg.page_id AND pl.field = 'content')),
fp AS MATERIALIZED (
  SELECT *, {conf(words('content'), '0.7')} AS confidence FROM (
    SELECT pg.page_id, fb.content, fb.n_paragraphs, {fields('g_title', 'g_author', any_date)}, fb.method
    FROM pg JOIN fb USING (page_id) LEFT JOIN gd USING (page_id))),
pr AS MATERIALIZED (
  SELECT s.page_id, u.* FROM sp s JOIN fp f USING (page_id), LATERAL (
    SELECT CASE WHEN s.confidence < 0.5 AND f.confidence > s.confidence THEN f.title ELSE s.title END AS title,
      CASE WHEN s.confidence < 0.5 AND f.confidence > s.confidence THEN f.author ELSE s.author END AS author,
      CASE WHEN s.confidence < 0.5 AND f.confidence > s.confidence THEN f.publish_date ELSE s.publish_date END AS publish_date,
      CASE WHEN s.confidence < 0.5 AND f.confidence > s.confidence THEN f.content ELSE s.content END AS content,
      CASE WHEN s.confidence < 0.5 AND f.confidence > s.confidence THEN f.n_paragraphs ELSE s.n_paragraphs END AS n_paragraphs,
      CASE WHEN s.confidence < 0.5 AND f.confidence > s.confidence THEN f.method ELSE s.method END AS method,
      CASE WHEN s.confidence < 0.5 AND f.confidence > s.confidence THEN f.confidence ELSE s.confidence END AS confidence) u)"""


def articles_ctes(source: str) -> str:
    return dom(source) + matches() + extraction() + parsing()


ARTICLES = (
    f"SELECT e.page_id, e.url, e.domain, p.title, p.author, strftime(p.publish_date, {STAMP}) AS publish_date, "
    "p.content, e.clean_content, e.word_count, e.paragraph_count, p.method AS extraction_method, "
    "p.confidence AS confidence_score, e.extractor_method, e.extraction_confidence FROM ex e JOIN pr p USING (page_id)"
)
