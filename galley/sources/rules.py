"""Site rules: which selectors find an article's fields on which site."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions.urls import site_key

RULE_SCHEMA = (
    "domain STRING, title_selector STRING, content_selector STRING, author_selector STRING, "
    "date_selector STRING, fallback_selectors ARRAY<STRING>"
)
GENERIC_SITE = "*"

# The selectors of the known sites and the generic ones.
_GUARDIAN = {
    "title_selector": "h1[data-gu-name='headline'], h1.content__headline",
    "content_selector": "div[data-gu-name='body'] p, div.content__article-body p",
    "author_selector": "a[rel='author'], .byline a, address a",
    "date_selector": "time[datetime], .content__dateline time",
    "fallback_selectors": ["article p", ".article-body p", ".content p", "main p"],
}
_TIMES_OF_INDIA = {
    "title_selector": "h1.HNMDR, h1._2yWcd, h1",
    "content_selector": "div._s30J p, div.ga-headlines p, .Normal p",
    "author_selector": ".byline, .author-name, .writer-name",
    "date_selector": ".publish-date, .date-line, time",
    "fallback_selectors": ["article p", ".story-content p", ".article-content p", "main p"],
}
_GENERIC = {
    "title_selector": "h1, .title, .headline",
    "content_selector": "article p, .content p, .article-body p, .story p",
    "author_selector": ".author, .byline, .writer",
    "date_selector": "time, .date, .published",
    "fallback_selectors": ["p", "div p", "main p", "section p"],
}
BUILT_IN = {
    "theguardian.com": _GUARDIAN,
    "www.theguardian.com": _GUARDIAN,
    "timesofindia.indiatimes.com": _TIMES_OF_INDIA,
    "www.timesofindia.indiatimes.com": _TIMES_OF_INDIA,
    GENERIC_SITE: _GENERIC,
}
# Selectors tried one after the other when a site's own ones find too little.
GENERIC_FIELDS = {
    "g_title": ["h1", ".title", ".headline", "[class*='title']", "[class*='headline']"],
    "g_content": ["article p", ".content p", ".article-body p", ".story p", "main p", "p"],
    "g_author": [".author", ".byline", ".writer", "[class*='author']", "[class*='byline']"],
    "g_date": ["time", ".date", ".published", "[class*='date']", "[class*='time']"],
}
# The domain format of a valid rule and the characters no selector may hold.
DOMAIN_FORMAT = (
    r"^(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)*"
    r"[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?$"
)
FORBIDDEN = r"[<>{}()]"
# The messages of faults.
EMPTY_DOMAIN = "Domain cannot be empty"
INVALID_DOMAIN = "Invalid domain format"
EMPTY_TITLE = "Title selector cannot be empty"
EMPTY_CONTENT = "Content selector cannot be empty"
EMPTY_FALLBACK = "Fallback selector cannot be empty"
INVALID_SYNTAX = "Invalid CSS selector syntax"
#: Our own: valid CSS perhaps, but not matched.
UNSUPPORTED = "Unsupported selector"

#: What selectors may consist of: steps of a tag, classes, an id, attribute tests, places among siblings and what a node
#: is not, with combinators between them.
MAX_STEPS = 5
#: Steps of the built-in selectors.
BUILT_IN_STEPS = 2
_ATTRIBUTE = r"""\[\s*[A-Za-z0-9_-]+\s*(?:[*^$~]?=\s*(?:"[^"\]]*"|'[^'\]]*'|[^\s"'\]]+)\s*)?\]"""
_SIMPLE = rf"(?:[.#][A-Za-z0-9_-]+|{_ATTRIBUTE})"
_NAME = r"(?:[a-zA-Z][a-zA-Z0-9-]*|\*)"
_COUNT = r"\(\s*(?:odd|even|[+-]?\d+|[+-]?\d*n(?:\s*[+-]\s*\d+)?)\s*\)"
_PLACE = rf":(?:(?:first|last|only)-(?:child|of-type)|nth-(?:last-)?(?:child|of-type){_COUNT})"
_NOT = rf":not\(\s*(?:{_NAME}{_SIMPLE}*|{_SIMPLE}+)\s*\)"
_STEP = rf"(?i)^(?={_NAME}|[.#:\[]){_NAME}?(?:{_SIMPLE}|{_PLACE}|{_NOT})*$"
_COMBINATOR = r"^[>+~]$"
_TEST_TYPE = "tag:string,id:string,classes:array<string>,attrs:array<struct<k:string,op:string,v:string>>"
_STEP_TYPE = (
    f"struct<{_TEST_TYPE},key:string,places:array<struct<of_type:boolean,from_end:boolean,a:int,b:int>>,"
    f"nots:array<struct<{_TEST_TYPE}>>>"
)


def built_in_rules(spark: SparkSession) -> DataFrame:
    """The built-in rule rows (a fixed, tiny table)."""
    rows = json.dumps([{"domain": domain, **rule} for domain, rule in BUILT_IN.items()])
    return spark.range(1).select(
        F.inline(F.from_json(F.lit(rows), f"ARRAY<STRUCT<{_struct_fields()}>>"))
    )


def _struct_fields() -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (f.split(" ") for f in RULE_SCHEMA.split(", ")))


def read_custom_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule rows from a JSON object ``{domain: {title_selector: ..., ...}}``; unreadable JSON gives none."""
    fields = ", ".join(f for f in _struct_fields().split(", ") if not f.startswith("domain:"))
    parsed = F.from_json(F.col("value"), f"MAP<STRING, STRUCT<{fields}>>")
    return (
        spark.read.text(path, wholetext=True)
        .select(F.explode(parsed).alias("domain", "rule"))
        .select("domain", "rule.*")
    )


def merge_rules(built_in: DataFrame, custom: DataFrame) -> DataFrame:
    """Built-in and custom rule rows, one per domain: a usable custom row wins, a bad one is dropped."""
    usable = custom.filter(
        "length(trim(domain)) > 0 AND length(title_selector) > 0 AND length(content_selector) > 0"
    ).withColumn("fallback_selectors", F.coalesce("fallback_selectors", F.array().cast("array<string>")))
    ranked = usable.withColumn("_rank", F.lit(0)).unionByName(built_in.withColumn("_rank", F.lit(1)))
    names = [f.split(" ")[0] for f in RULE_SCHEMA.split(", ")]
    rule = F.struct(*[n for n in names if n != "domain"])
    order = F.struct(F.col("_rank"), F.to_json(rule))
    return ranked.groupBy("domain").agg(F.min_by(rule, order).alias("rule")).select("domain", "rule.*")


def load_site_rules(spark: SparkSession, custom: str | DataFrame | None = None) -> DataFrame:
    """All rule rows: the built-in ones, plus custom ones from a JSON file or a frame."""
    base = built_in_rules(spark)
    if custom is None:
        return base
    rows = read_custom_rules(spark, custom) if isinstance(custom, str) else custom
    return merge_rules(base, rows)


def site_table(rules: DataFrame) -> DataFrame:
    """One row per site key; a rule for the plain domain goes before one for its ``www.`` form."""
    is_www = F.col("domain").startswith("www.")
    keyed = rules.withColumn("site", site_key(F.col("domain")))
    rule = F.struct(*[c for c in keyed.columns if c != "site"])
    return keyed.groupBy("site").agg(F.min_by(rule, is_www).alias("rule")).select("site", "rule.*")


def supported_domains(rules: DataFrame) -> DataFrame:
    """Domains with rules of their own."""
    return rules.filter(F.col("domain") != GENERIC_SITE).select("domain").distinct()


def alternatives(selector: Column) -> Column:
    """The comma-separated parts of a selector; commas inside brackets do not count."""
    return F.regexp_extract_all(selector, F.lit(r"(?:\[[^\]]*\]|\([^)]*\)|[^,\[(])+"), F.lit(0))


def _tokens(part: Column) -> Column:
    """Steps and the signs between them in order; signs and blanks inside brackets do not count."""
    return F.regexp_extract_all(part, F.lit(r"[>+~]|(?:\[[^\]]*\]|\([^)]*\)|[^\s>+~\[(])+"), F.lit(0))


def steps_of(part: Column) -> Column:
    """The steps of one part with what stands before each: ``>``, ``+``, ``~`` or a blank for descendants."""
    tokens = _tokens(part)
    steps = F.transform(tokens, lambda t, i: F.struct(t.alias("text"), F.get(tokens, i - 1).alias("before")))
    return F.transform(
        F.filter(steps, lambda s: ~s.text.rlike(_COMBINATOR)),
        lambda s: F.struct(s.text.alias("text"), F.when(s.before.rlike(_COMBINATOR), s.before).otherwise(" ").alias("sign")),
    )


def is_supported(part: Column) -> Column:
    """One to MAX_STEPS steps of what ``parsed_step`` reads, with one sign between two of them at most."""
    tokens = _tokens(part)
    is_sign = lambda t: t.rlike(_COMBINATOR)
    steps = F.filter(tokens, lambda t: ~is_sign(t))
    misplaced = F.exists(
        F.transform(tokens, lambda t, i: is_sign(t) & F.coalesce(is_sign(F.get(tokens, i + 1)), F.lit(True))), lambda odd: odd
    )
    leads = F.coalesce(is_sign(F.get(tokens, F.lit(0))), F.lit(True))
    return F.size(steps).between(1, MAX_STEPS) & F.forall(steps, lambda s: s.rlike(_STEP)) & ~misplaced & ~leads


def _simple_test(text: Column) -> tuple[Column, Column, Column, Column]:
    """Tag, id, classes and attribute tests of a compound."""
    tests = F.regexp_extract_all(text, F.lit(_ATTRIBUTE), F.lit(0))
    bare = F.regexp_replace(text, r"\[[^\]]*\]", "")
    names = lambda mark: F.regexp_extract_all(bare, F.lit(rf"{mark}([A-Za-z0-9_-]+)"), F.lit(1))
    tag = F.lower(F.regexp_extract(bare, r"^([a-zA-Z][a-zA-Z0-9-]*)", 1))
    known = r"""(?s)^\[\s*([A-Za-z0-9_-]+)\s*(?:([*^$~]?=)\s*["']?(.*?)["']?\s*)?\]$"""

    def test(part: Column) -> Column:
        op = F.regexp_extract(part, known, 2)
        return F.struct(
            F.lower(F.regexp_extract(part, known, 1)).alias("k"),
            F.when(op != "", op).alias("op"),
            F.when(op != "", F.regexp_extract(part, known, 3)).alias("v"),
        )

    return F.when(tag != "", tag), F.get(names("#"), F.lit(0)), names(r"\."), F.transform(tests, test)


def _places(step: Column) -> Column:
    """Tests of the place among siblings, as (of_type, from_end, a, b): some a * n + b, n from 0, is the place from 1."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(step, r"\[[^\]]*\]", ""), r"(?i):not\([^)]*\)", ""))
    found = F.regexp_extract_all(bare, F.lit(r":[a-z-]+(?:\([^)]*\))?"), F.lit(0))

    def numbers(text: Column) -> tuple[Column, Column]:
        count = F.regexp_replace(F.regexp_extract(text, r"\(([^)]*)\)", 1), r"\s+", "")
        count = F.when(count == "odd", "2n+1").when(count == "even", "2n").when(count == "", "1").otherwise(count)
        steps = F.regexp_extract(count, r"^([+-]?\d*)n", 1)
        a = F.when(~count.contains("n"), "0").when(steps.isin("", "+"), "1").when(steps == "-", "-1").otherwise(steps)
        b = F.when(count.contains("n"), F.regexp_extract(count, r"n([+-]\d+)$", 1)).otherwise(count)
        return a.cast("int"), F.when(b == "", 0).otherwise(b.cast("int"))

    def place(text: Column, from_end: Column) -> Column:
        a, b = numbers(text)
        return F.struct(text.contains("of-type").alias("of_type"), from_end.alias("from_end"), a.alias("a"), b.alias("b"))

    once = F.transform(found, lambda t: place(t, t.contains("last")))
    only = F.transform(F.filter(found, lambda t: t.contains("only")), lambda t: place(t, F.lit(True)))
    return F.concat(once, only)


def parsed_step(step: Column) -> Column:
    """A step as a test. ``key`` is the one property a node is looked up by before it is tested."""
    outer = F.regexp_replace(step, r"(?i):not\([^)]*\)", "")
    inner = F.regexp_extract_all(step, F.lit(r"(?i):not\(\s*([^)]*?)\s*\)"), F.lit(1))

    def simple(text: Column) -> list[Column]:
        return [c.alias(n) for c, n in zip(_simple_test(text), ("tag", "id", "classes", "attrs"), strict=True)]

    tag, first_id, classes, attrs = _simple_test(outer)
    key = F.coalesce(
        F.concat(F.lit("#"), first_id),
        F.concat(F.lit("."), F.get(classes, F.lit(0))),
        tag,
        F.concat(F.lit("["), F.get(F.transform(attrs, lambda a: a.k), F.lit(0))),
        F.lit("*"),
    )
    return F.struct(
        *simple(outer), key.alias("key"), _places(step).alias("places"), F.transform(inner, lambda t: F.struct(*simple(t))).alias("nots")
    ).cast(_STEP_TYPE)


def _field_rows(sites: DataFrame) -> DataFrame:
    """One row per site, field, priority and comma alternative."""

    def field(name: str, selectors: Column) -> Column:
        return F.transform(
            selectors,
            lambda s, i: F.struct(F.lit(name).alias("field"), i.alias("priority"), s.alias("selector")),
        )

    own = [
        field(name, F.filter(F.array(F.col(f"{name}_selector")), lambda s: s.isNotNull()))
        for name in ("title", "content", "author", "date")
    ]
    generic = [field(n, F.array(*[F.lit(s) for s in sels])) for n, sels in GENERIC_FIELDS.items()]
    rows = sites.select(
        "site", F.inline(F.concat(*own, field("fallback", F.col("fallback_selectors")), *generic))
    )
    return rows.select("*", F.posexplode(alternatives(F.col("selector"))).alias("alt", "part"))


def selector_rows(sites: DataFrame) -> DataFrame:
    """One row per step of every selector: ``site, field, priority, alt, selector, steps, level, sign, placed, step``.

    Supported: tag, classes, id, attribute presence, ``=``, ``*=``, ``^=``, ``$=`` and ``~=``; the places
    ``:first-``, ``:last-``, ``:only-`` and ``:nth-`` (``:nth-last-``) ``child`` and ``of-type``; ``:not()`` of a
    compound; and up to MAX_STEPS steps with descendant, ``>``, ``+`` and ``~`` between them. ``level``
    counts steps from the outermost, from 1; ``sign`` stands before the step; ``placed`` says that the
    selector asks for parents or siblings. Anything else is left out here and reported by
    ``validate_site_rules``.
    """
    rows = _field_rows(sites).filter(is_supported(F.col("part"))).withColumn("_steps", steps_of(F.col("part")))
    signs = F.exists("_steps", lambda s: s.sign != " ")
    places = F.exists("_steps", lambda s: F.regexp_replace(s.text, r"\[[^\]]*\]|(?i:not\([^)]*\))", "").rlike(r":[a-zA-Z]"))
    rows = rows.select(
        "site", "field", "priority", "alt", "selector", F.size("_steps").alias("steps"), (signs | places).alias("placed"),
        F.posexplode("_steps").alias("_at", "_one"),
    )
    return rows.select(
        "site", "field", "priority", "alt", "selector", "steps", (F.col("_at") + 1).alias("level"),
        F.col("_one.sign").alias("sign"), "placed", parsed_step(F.col("_one.text")).alias("step"),
    )


def validate_site_rules(rules: DataFrame) -> DataFrame:
    """One row per fault of a rule: ``domain, field, message, value``.

    A selector with a part that ``selector_rows`` leaves out is a fault of its own, besides bad syntax.
    """
    none = F.lit(None).cast("string")

    def fault(test: Column, field: Column | str, message: str, value: Column) -> Column:
        name = F.lit(field) if isinstance(field, str) else field
        return F.when(test, F.struct(name.alias("field"), F.lit(message).alias("message"), value.alias("value")))

    def blank(col: Column) -> Column:
        return F.coalesce(F.trim(col) == "", F.lit(True))

    domain = F.col("domain")
    faults = [
        fault(blank(domain), "domain", EMPTY_DOMAIN, none),
        fault(
            ~blank(domain) & (domain != GENERIC_SITE) & ~domain.rlike(DOMAIN_FORMAT),
            "domain", INVALID_DOMAIN, domain,
        ),
        fault(blank(F.col("title_selector")), "title_selector", EMPTY_TITLE, none),
        fault(blank(F.col("content_selector")), "content_selector", EMPTY_CONTENT, none),
    ]
    def unsupported(selector: Column) -> Column:
        return F.exists(alternatives(selector), lambda part: ~is_supported(part)) | selector.rlike(r"^\s*,|,\s*(,|$)")

    for name in ("title_selector", "content_selector", "author_selector", "date_selector"):
        col = F.col(name)
        bad = (F.length(col) > 0) & (blank(col) | col.rlike(FORBIDDEN))
        faults.append(fault(bad, name, INVALID_SYNTAX, col))
        faults.append(fault(~blank(col) & unsupported(col), name, UNSUPPORTED, col))

    def fallback(selector: Column, i: Column) -> Column:
        name = F.format_string("fallback_selectors[%d]", i)
        return F.coalesce(
            fault(blank(selector), name, EMPTY_FALLBACK, none),
            fault(selector.rlike(FORBIDDEN), name, INVALID_SYNTAX, selector),
        )

    def fallback_left_out(selector: Column, i: Column) -> Column:
        name = F.format_string("fallback_selectors[%d]", i)
        return fault(~blank(selector) & unsupported(selector), name, UNSUPPORTED, selector)

    all_faults = F.concat(
        F.array(*faults),
        F.coalesce(F.transform("fallback_selectors", fallback), F.array()),
        F.coalesce(F.transform("fallback_selectors", fallback_left_out), F.array()),
    )
    return rules.select("domain", F.inline(F.filter(all_faults, lambda f: f.isNotNull())))
