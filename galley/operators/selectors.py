"""Selector matching as an equi join of node keys with rule steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.functions.markup import class_list
from galley.functions.urls import domain_of, site_key
from galley.operators.skew import spread_join
from galley.sources.rules import GENERIC_SITE, MAX_STEPS

RULE = ["field", "priority", "alt"]
STEP = [*RULE, "selector", "steps", "level", "sign", "step"]


def attach_site(pages: DataFrame, sites: DataFrame, small: bool = True) -> DataFrame:
    """Add ``domain``, ``site`` (the rule site, ``*`` when there is none) and ``supported``.

    ``small`` says that the rules are the built-in handful, which is broadcast. Rules of a user may be
    any number: they are joined by shuffle with sites of many pages cut into parts.
    """
    known = sites.filter(F.col("site") != GENERIC_SITE).select(F.col("site").alias("_key"), F.col("site"))
    keyed = pages.withColumn("domain", domain_of(F.col("url"))).withColumn("_key", site_key(F.col("domain")))
    joined = keyed.join(F.broadcast(known), "_key", "left") if small else spread_join(keyed, known, ["_key"], "page_id")
    return (
        joined.withColumn("supported", F.col("site").isNotNull())
        .withColumn("site", F.coalesce("site", F.lit(GENERIC_SITE)))
        .drop("_key")
    )


def node_keys(tag: Column, attrs: Column, classes: Column) -> Column:
    """All keys a step may look this node up by."""
    names = F.array_distinct(F.transform(attrs, lambda a: a.k))
    ids = F.transform(F.filter(attrs, lambda a: a.k == "id"), lambda a: F.concat(F.lit("#"), a.v))
    return F.concat(
        F.array(F.lit("*"), tag),
        F.transform(F.array_distinct(classes), lambda c: F.concat(F.lit("."), c)),
        F.transform(names, lambda n: F.concat(F.lit("["), n)),
        F.array_distinct(ids),
    )


def passes(step: Column, tag: Column, attrs: Column, classes: Column, place: Column | None = None) -> Column:
    """The node passes the whole test of a step; its place among siblings counts where ``place`` is given."""

    def holds(test: Column) -> Column:
        def one(a: Column) -> Column:
            value = F.when(a.k == "class", F.trim(F.regexp_replace(a.v, r"\s+", " "))).otherwise(a.v)
            filled = F.length(test.v) > 0
            word = filled & ~test.v.contains(" ") & F.array_contains(F.split(value, r"\s+"), test.v)
            result = (
                F.when(test.op.isNull(), F.lit(True))
                .when(test.op == "=", value == test.v)
                .when(test.op == "*=", filled & value.contains(test.v))
                .when(test.op == "^=", filled & value.startswith(test.v))
                .when(test.op == "$=", filled & value.endswith(test.v))
                .otherwise(word)
            )
            return (a.k == test.k) & result

        return F.exists(attrs, one)

    def simple(test: Column) -> Column:
        return (
            (test.tag.isNull() | (test.tag == tag))
            & (test.id.isNull() | F.exists(attrs, lambda a: (a.k == "id") & (a.v == test.id)))
            & (F.size(F.array_except(test.classes, classes)) == 0)
            & F.forall(test.attrs, holds)
        )

    def stands(wanted: Column) -> Column:
        index = F.when(wanted.of_type, F.when(wanted.from_end, place.nth_last_type).otherwise(place.nth_type)).otherwise(
            F.when(wanted.from_end, place.nth_last).otherwise(place.nth)
        )
        ahead = index - wanted.b
        return F.when(wanted.a == 0, ahead == 0).otherwise((ahead % wanted.a == 0) & (ahead * wanted.a >= 0))

    passed = simple(step) & ~F.exists(step.nots, simple)
    return passed if place is None else passed & F.forall(step.places, stands)


def _related(met: DataFrame, level: int, inside: Column) -> tuple[DataFrame, Column]:
    """The rows, and whether a node stands to a hit of step ``level`` as the sign before the next step says."""
    is_hit = (F.col("level") == level) & F.col("_in")
    elders = Window.partitionBy("page_id", *RULE, "place.parent").orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("_elder", F.max(F.when(is_hit, F.col("place.nth"))).over(elders))
    # a hit stands in the family it heads, once, besides the one it belongs to
    roles = F.when(F.col("field").isNotNull() & is_hit, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    met = met.withColumn("_heads", F.explode(roles))
    met = met.withColumn("_family", F.when(F.col("_heads"), F.col("pos")).otherwise(F.col("place.parent")))
    family = Window.partitionBy("page_id", *RULE, "_family")
    met = met.withColumn("_kin", F.max(F.col("_heads")).over(family) & F.col("_family").isNotNull())
    met = met.filter(~F.col("_heads")).drop("_heads", "_family")
    sign = F.col("sign")
    related = (
        F.when(sign == ">", F.col("_kin"))
        .when(sign == "+", F.coalesce(F.col("_elder") == F.col("place.nth") - 1, F.lit(False)))
        .when(sign == "~", F.col("_elder").isNotNull())
        .otherwise(inside)
    )
    return met, related


def match_rows(
    rows: DataFrame, selectors: DataFrame, small: bool = True, max_steps: int = MAX_STEPS, parts: int | None = None
) -> DataFrame:
    """Every DOM row once (``field`` NULL), plus one row per node and rule it is a hit of.

    ``rows`` are DOM rows with ``site``, and with ``place`` if rules may ask for parents and siblings;
    without it such rules match nothing. A node is looked up by its few keys (tag, classes, id,
    attribute names), so a rule meets only nodes that share the key of one of its steps; text rows
    meet none. A descendant step needs no node pairs: a node is inside one of the step before when
    the furthest end of those that started earlier lies behind it, a running maximum per page and
    rule over the matched nodes only. Siblings before are a running maximum within the parent, and a
    child looks for its parent's row in the family the parent heads: equality of (page, rule, parent), no pairs.

    Rules of the generic site are a handful and broadcast, like the built-in ones (``small``). Those
    of a user's sites (with up to ``max_steps`` steps) are joined by (site, key) with popular ones cut into parts, from which nodes of
    the generic site are kept apart. ``parts`` is the number of parts the pages are in (``sized_parts``): the rows
    then go to the rules and back to their pages in as many, so that no task grows with the input.
    """
    is_node = F.col("kind").isin("open", "void")
    classes = F.when(F.size("attrs") > 0, class_list(F.col("attrs"))).otherwise(F.array().cast("array<string>"))
    keys = F.when(is_node, node_keys(F.col("tag"), F.col("attrs"), F.col("_classes")))
    keyed = rows.withColumn("_classes", F.when(is_node, classes)).withColumn(
        "_key", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce(keys, F.array().cast("array<string>"))))
    )
    placed = "place" in rows.columns
    usable = selectors if placed else selectors.filter(~F.col("placed"))
    steps = usable.select("site", F.col("step.key").alias("_key"), *STEP)
    broadcast = steps if small else steps.filter(F.col("site") == GENERIC_SITE)
    joined = keyed.join(F.broadcast(broadcast), ["site", "_key"], "left")
    if not small:
        own = steps.filter(F.col("site") != GENERIC_SITE)
        renamed = {name: f"_own_{name}" for name in STEP}
        own = own.select(F.concat_ws("\n", "site", "_key").alias("_own_key"), *[F.col(n).alias(r) for n, r in renamed.items()])
        # rows that cannot match get keys of their own, so they spread
        apart = F.concat(F.lit("\n"), F.col("page_id").cast("string"), F.lit("-"), F.col("pos").cast("string"))
        key = F.when((F.col("site") != GENERIC_SITE) & F.col("_key").isNotNull(), F.concat_ws("\n", "site", "_key"))
        joined = spread_join(joined.withColumn("_own_key", F.coalesce(key, apart)), own, ["_own_key"], "page_id", tasks=parts)
        joined = joined.withColumns({n: F.coalesce(F.col(n), F.col(r)) for n, r in renamed.items()}).drop("_own_key", *renamed.values())
    meets = F.col("field").isNotNull() & passes(F.col("step"), F.col("tag"), F.col("attrs"), F.col("_classes"), F.col("place") if placed else None)
    met = joined.filter(F.col("_key").isNull() | F.coalesce(meets, F.lit(False)))
    if parts and not small:
        met = met.repartition(parts, "page_id")
    before = Window.partitionBy("page_id", *RULE).orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("_in", F.col("level") == 1)
    for level in range(1, max_steps):
        reach = F.max(F.when((F.col("level") == level) & F.col("_in"), F.col("end"))).over(before)
        inside = F.coalesce(reach > F.col("pos"), F.lit(False))
        if placed:
            met, inside = _related(met, level, inside)
        met = met.withColumn("_in", F.when(F.col("level") == level + 1, inside).otherwise(F.col("_in")))
    hit = F.col("field").isNull() | (F.col("_in") & (F.col("level") == F.col("steps")))
    return met.filter(hit).drop("_key", "_classes", "_in", "level", "steps", "sign", "step", "_kin", "_elder")


def match_selectors(
    rows: DataFrame, selectors: DataFrame, small: bool = True, parts: int | None = None
) -> DataFrame:
    """Nodes matched per field and priority, each once however many alternatives fit."""
    return (
        match_rows(rows, selectors, small, parts=parts)
        .filter("field IS NOT NULL")
        .groupBy("page_id", "field", "priority", "pos")
        .agg(F.first("end").alias("end"), F.first("tag").alias("tag"), F.first("gone").alias("gone"))
        .withColumnRenamed("pos", "start")
    )
