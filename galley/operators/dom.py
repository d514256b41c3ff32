"""A page as rows: tokens, node intervals, text runs and running counts.

Everything is keyed by ``page_id`` and ordered by ``pos``. Containment questions are answered with
running maxima and running sums over one ordered pass per page, never by pairing nodes with runs, so
the work of a page grows with its length and not with its square.

The raw pages are hashed by ``page_id`` once, before they are broken up, into parts of bounded size (see
``sized_parts``); every later window and aggregate is partitioned by ``page_id`` and reuses that placement. A page table that is bucketed by
``page_id`` needs no exchange at all (``clustered=True``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galley.functions.markup import (
    TOKEN,
    attribute_list,
    attribute_map,
    decode_entities,
    tag_name,
    token_kind,
)
from galley.functions.text import NOT_BLANK, sanitize_text, word_count
from galley.operators.boilerplate import boilerplate_reason
from galley.operators.reports import skipped_reason
from galley.operators.skew import sized_parts

# Fixed value: a <p> ends where the next one starts, where it is closed, or where one of these closes.
P_CLOSERS = (
    "address", "article", "aside", "blockquote", "body", "div", "fieldset", "figure", "footer",
    "form", "header", "html", "li", "main", "nav", "ol", "section", "table", "td", "ul",
)


def page_parts(pages: DataFrame) -> int:
    """The number of parts that pages are broken up in."""
    return sized_parts(pages, F.length("html"))


def tokenize(
    pages: DataFrame, keep: tuple[str, ...] = (), clustered: bool = False, parts: int | None = None
) -> DataFrame:
    """Page rows to token rows ``page_id, pos, kind, tag, t``; an ``eof`` row ends every page.

    ``keep`` names further page columns to carry along; they stand on the ``eof`` row only, so they
    are not copied with every token. ``site`` is the exception: rules are joined on it. ``parts`` is
    ``page_parts`` where that is known.
    """
    source = pages.filter("html IS NOT NULL").select("page_id", *keep, "html")
    if not clustered:
        source = source.repartition(parts or page_parts(source), "page_id")
    tokens = F.concat(
        F.regexp_extract_all(sanitize_text(F.col("html")), F.lit(TOKEN), F.lit(0)), F.array(F.lit(""))
    )
    rows = source.select("page_id", *keep, F.posexplode(tokens).alias("pos", "t"))
    rows = rows.withColumn("kind", token_kind(F.col("t")))
    is_tag = F.col("kind").isin("open", "close", "void")
    kept = [F.col(c) if c == "site" else F.when(F.col("kind") == "eof", F.col(c)).alias(c) for c in keep]
    return rows.select("page_id", *kept, "pos", "kind", F.when(is_tag, tag_name(F.col("t"))).alias("tag"), "t")


def close_nodes(tokens: DataFrame) -> DataFrame:
    """Add ``end`` to the open and void rows: the position of the token that closes the node.

    Per tag, the depth after an open equals the depth before its close, and at one depth opens and
    closes alternate, so the next row of the same tag and depth is the close. A node that is never
    closed ends with the closest enclosing node that is, or with the page. A ``<p>`` follows its own
    rule (see ``P_CLOSERS``). A void node is empty: its end is its own position.
    """
    pos, kind, tag = F.col("pos"), F.col("kind"), F.col("tag")
    is_open, is_close = kind == "open", kind == "close"
    per_tag = Window.partitionBy("page_id", "tag").orderBy("pos")
    step = F.when(is_open, 1).when(is_close, -1).otherwise(0)
    rows = tokens.withColumn("_depth", F.sum(step).over(per_tag))
    rows = rows.withColumn("_level", F.col("_depth") + F.when(is_close, 1).otherwise(0))
    per_level = Window.partitionBy("page_id", "tag", "_level").orderBy("pos")
    rows = rows.withColumn("_own", F.when(is_open, F.lead("pos").over(per_level)))
    rows = rows.withColumn("_prev", F.when(is_close, F.lag("kind").over(per_level)))
    not_p = tag != "p"
    opened = is_open & not_p & F.col("_own").isNotNull()
    closed = is_close & not_p & (F.col("_prev") == "open")
    whole = Window.partitionBy("page_id").orderBy("pos")
    change = F.when(opened, 1).when(closed, -1).otherwise(0)
    rows = rows.withColumn("_in", F.sum(change).over(whole) + F.when(closed, 1).otherwise(0))
    # looking ahead is a running minimum over the reversed order
    ahead = Window.partitionBy("page_id", "_in").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_parent", F.min(F.when(closed & (F.col("_in") > 0), pos)).over(ahead))
    p_event = ((tag == "p") & (is_open | is_close)) | (is_close & tag.isin(*P_CLOSERS))
    after = Window.partitionBy("page_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_p_end", F.min(F.when(p_event, pos)).over(after))
    rows = rows.withColumn("_eof", F.max(pos).over(after))
    parent = F.when(F.col("_in") > 0, F.col("_parent"))
    end = (
        F.when(kind == "void", pos)
        .when(is_open & (tag == "p"), F.coalesce("_p_end", "_eof"))
        .when(is_open, F.coalesce(F.col("_own"), parent, F.col("_eof")))
    )
    return rows.withColumn("end", end).drop("_depth", "_level", "_own", "_prev", "_in", "_parent", "_p_end", "_eof")


def with_attrs(tokens: DataFrame) -> DataFrame:
    """Add the attribute list of open and void rows."""
    return tokens.withColumn("attrs", F.when(F.col("kind").isin("open", "void"), attribute_list(F.col("t"))))


def node_table(pages: DataFrame, clustered: bool = False) -> DataFrame:
    """Nodes as intervals ``page_id, start, end, tag, attrs``."""
    rows = with_attrs(close_nodes(tokenize(pages, clustered=clustered)))
    return rows.filter(F.col("kind").isin("open", "void")).select(
        "page_id", F.col("pos").alias("start"), "end", "tag", "attrs"
    )


def node_attributes(nodes: DataFrame) -> DataFrame:
    """Nodes with their attributes as a map, the last duplicate winning."""
    return nodes.withColumn("attrs", attribute_map(F.col("attrs")))


def text_runs(pages: DataFrame, clustered: bool = False) -> DataFrame:
    """Text tokens with entities decoded: ``page_id, pos, text``."""
    return (
        tokenize(pages, clustered=clustered)
        .filter("kind = 'text'")
        .select("page_id", "pos", decode_entities(F.col("t")).alias("text"))
    )


def dom_rows(
    pages: DataFrame,
    keep: tuple[str, ...] = (),
    mode: str = "substring",
    clustered: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """Token rows with node ends, boilerplate marks and running counts up to and with each row.

    ``gone``: inside boilerplate, or boilerplate itself. ``run``: the decoded text of a text row.
    Running counts of what stays: ``n_runs`` non-blank runs, ``n_words`` their words, ``n_p`` and
    ``n_a`` the ``<p>`` and ``<a>`` nodes; ``n_text`` counts all text rows, removed or not.
    A count over a node is the value at its end minus the value at its start.
    """
    pos, kind, tag = F.col("pos"), F.col("kind"), F.col("tag")
    rows = with_attrs(close_nodes(tokenize(pages, keep, clustered, parts)))
    reason = F.when(kind.isin("open", "void"), boilerplate_reason(tag, F.col("attrs"), mode))
    rows = rows.withColumn("reason", reason)
    rows = rows.withColumn("run", F.when(kind == "text", decode_entities(F.col("t"))))
    rows = rows.withColumn("skipped", F.when(kind == "skip", skipped_reason(F.col("t")))).drop("t")
    so_far = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("end")
    rows = rows.select(
        "*",
        F.max(F.when(F.col("reason").isNotNull(), end)).over(so_far).alias("_gone_to"),
        F.max(F.when(~F.col("reason").startswith("pattern"), end)).over(so_far).alias("_tag_gone_to"),
    )
    gone = F.col("reason").isNotNull() | (F.coalesce(F.col("_gone_to"), F.lit(-1)) > pos)
    is_run = (kind == "text") & ~F.col("gone") & F.col("run").rlike(NOT_BLANK)
    rows = rows.withColumn("gone", gone).withColumn("kept", is_run)
    rows = rows.withColumn("_words", F.when(F.col("kept"), word_count(F.col("run"))).otherwise(0))

    def running(value, name):
        return F.sum(value).over(so_far).cast("int").alias(name)

    open_stays = (kind == "open") & ~F.col("gone")
    return rows.select(
        "page_id", *keep, "pos", "kind", "tag", "end", "attrs", "reason", "skipped", "run", "gone", "kept",
        (F.coalesce(F.col("_tag_gone_to"), F.lit(-1)) > pos).alias("in_removed_tag"),
        running(F.when(F.col("kept"), 1).otherwise(0), "n_runs"),
        running(F.col("_words"), "n_words"),
        running(F.when(open_stays & (tag == "p"), 1).otherwise(0), "n_p"),
        running(F.when(open_stays & (tag == "a"), 1).otherwise(0), "n_a"),
        running(F.when(kind == "text", 1).otherwise(0), "n_text"),
    )


def with_places(rows: DataFrame) -> DataFrame:
    """Add ``place`` to node rows: parent, and the place among the parent's nodes from both ends, of all and of the same tag.

    A page is one ordered pass over the starts and ends of its nodes. The level of a node is the number
    of nodes open before it; its parent is the last node one level up that starts before it, so a
    node's ordinal is a row number within its parent. All of it reuses the placement by ``page_id``.
    Where end tags cross, nodes count as closed in the order in which they would nest. Nodes
    outside any other have no parent and are siblings of each other. Other rows have no ``place``.
    """
    pos, kind = F.col("pos"), F.col("kind")
    is_open, is_node = kind == "open", kind.isin("open", "void")

    def event(at, step, own):
        return F.struct(at.cast("int").alias("at"), F.lit(step).alias("step"), F.lit(own).alias("own"))

    events = F.when(is_open, F.array(event(pos, 1, True), event(F.col("end"), -1, False))).otherwise(F.array(event(pos, 0, True)))
    so_far = Window.partitionBy("page_id").orderBy("_event.at", "_event.own").rowsBetween(Window.unboundedPreceding, -1)
    level = F.coalesce(F.sum("_event.step").over(so_far), F.lit(0)).cast("int")
    levelled = rows.withColumn("_event", F.explode(events)).withColumn("_level", level).filter("_event.own").drop("_event")
    # an open node stands in the family it heads, once, besides the one it belongs to
    roles = F.when(is_open, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    family = F.when(is_node, F.col("_level") - F.when(F.col("_heads"), 0).otherwise(1))
    before = Window.partitionBy("page_id", "_family").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    headed = levelled.withColumn("_heads", F.explode(roles)).withColumn("_family", family)
    headed = headed.withColumn("_parent", F.when(is_node, F.max(F.when(F.col("_heads"), pos)).over(before)))
    own = headed.filter(~F.col("_heads")).withColumn("_node", is_node)
    among = Window.partitionBy("page_id", "_node", "_parent")
    alike = Window.partitionBy("page_id", "_node", "_parent", "tag")
    at, at_alike = F.row_number().over(among.orderBy("pos")), F.row_number().over(alike.orderBy("pos"))
    place = F.struct(
        F.col("_parent").alias("parent"), at.alias("nth"), (F.count("*").over(among) - at + 1).cast("int").alias("nth_last"),
        at_alike.alias("nth_type"), (F.count("*").over(alike) - at_alike + 1).cast("int").alias("nth_last_type"),
    )
    return own.withColumn("place", F.when(F.col("_node"), place)).drop("_level", "_heads", "_family", "_parent", "_node")
