"""The extraction branch: site selectors, readability scoring, generic text, and the choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions.scores import extraction_confidence, quality_warning
from galley.functions.text import block_words, formatting_info, is_good_blocks, paragraph_count
from galley.operators.records import CONTAINERS, hits_of, kept_text, token_at


_NODE = "struct<pos:int,end:int>"


def site_texts() -> Column:
    """Non-empty texts of the site's content nodes, in document order."""
    texts = F.transform(
        F.filter(hits_of("content"), lambda h: ~h.gone), lambda h: kept_text(h.pos, h.end)
    )
    return F.filter(texts, lambda t: t != "")


def readability_score(hits: Column, words: Column, paragraphs: Column, links: Column) -> Column:
    """Points for content names, length and paragraphs, less for many links; never below 0."""
    score = hits * 10.0
    has_text = words > 0
    score += F.when(words > 100, 20.0).when(words > 50, 10.0).when(words > 20, 5.0).otherwise(0.0)
    score += F.when(has_text & (paragraphs > 3), 15.0).when(has_text & (paragraphs > 1), 5.0).otherwise(0.0)
    score += F.when(links > 10, -10.0).otherwise(0.0)
    return F.greatest(score, F.lit(0.0))


def candidates() -> Column:
    """Candidate containers of a record with their features and score.

    Words are counted as if runs were glued without a separator: the last word of one run and the
    first of the next become one, so the count is the words of all runs less the seams.
    """
    rank = F.array(*[F.lit(c) for c in CONTAINERS])
    nodes = F.filter("toks", lambda t: (t.kind == "open") & ~t.gone & t.tag.isin(*CONTAINERS))

    def features(n: Column) -> Column:
        end = token_at(n.end)
        runs = end.n_runs - n.n_runs
        words = (end.n_words - n.n_words) - F.greatest(runs - 1, F.lit(0))
        inner_p, inner_a = end.n_p - n.n_p, end.n_a - n.n_a
        return F.struct(
            n.pos.alias("start"),
            n.end.alias("end"),
            n.tag.alias("tag"),
            F.array_position(rank, n.tag).cast("int").alias("tag_rank"),
            n.content_hits.alias("content_hits"),
            words.alias("words"),
            inner_p.alias("paragraphs"),
            inner_a.alias("links"),
            readability_score(n.content_hits, words, inner_p, inner_a).alias("score"),
        )

    return F.transform(nodes, features)


def best_container() -> Column:
    """The candidate with the highest score above 0; ties by container order, then position."""
    keyed = F.transform(
        F.filter("candidates", lambda c: c.score > 0),
        lambda c: F.struct((-c.score).alias("a"), c.tag_rank.alias("b"), c.start.alias("s"), c.alias("c")),
    )
    return F.array_min(keyed).c


def generic_paragraphs() -> Column:
    """Paragraph texts of more than 10 words."""
    nodes = F.filter("toks", lambda t: (t.kind == "open") & ~t.gone & (t.tag == "p"))
    return F.filter(F.transform(nodes, lambda n: kept_text(n.pos, n.end)), lambda t: block_words(t) > 10)


def first_container_text() -> Column:
    """The first text of more than 20 words among divs, then sections, then articles; '' if none."""

    def long_enough(n: Column) -> Column:
        # running counts settle most nodes; a text is built only where the clean-up may take words away
        words = token_at(n.end).n_words - n.n_words
        return (words > 20) & (block_words(kept_text(n.pos, n.end)) > 20)

    def first_of(tag: str) -> Column:
        nodes = F.filter("toks", lambda t: (t.kind == "open") & ~t.gone & (t.tag == tag))
        # stops building texts at the first that is long enough
        found = F.aggregate(
            nodes,
            F.lit(None).cast(_NODE),
            lambda best, n: F.when(best.isNotNull(), best).when(long_enough(n), F.struct(n.pos.alias("pos"), n.end.alias("end"))).otherwise(best),
        )
        return F.when(found.isNotNull(), kept_text(found.pos, found.end))

    return F.coalesce(first_of("div"), first_of("section"), first_of("article"), F.lit(""))


def extract(records: DataFrame) -> DataFrame:
    """Add the extraction of every page: text, method, counts, confidence, warning, formatting.

    A later method is evaluated only for pages the earlier ones did not settle.
    """
    rows = records.withColumn("site_text", F.array_join(site_texts(), "\n\n"))
    rows = rows.withColumn("_by_site", is_good_blocks(F.col("site_text")))
    rows = rows.withColumn("candidates", F.when(~F.col("_by_site"), candidates()))
    rows = rows.withColumn("best", F.when(~F.col("_by_site"), best_container()))
    best = F.col("best")
    rows = rows.withColumn(
        "readability_text", F.when(best.isNotNull(), kept_text(best.start, best.end)).otherwise("")
    )
    rows = rows.withColumn("_by_score", ~F.col("_by_site") & is_good_blocks(F.col("readability_text")))
    rows = rows.withColumn(
        "_paragraphs", F.when(~F.col("_by_site") & ~F.col("_by_score"), generic_paragraphs())
    )
    generic = F.when(F.size("_paragraphs") > 0, F.array_join("_paragraphs", "\n\n")).otherwise(
        first_container_text()
    )
    rows = rows.withColumn(
        "clean_content",
        F.when(F.col("_by_site"), F.col("site_text"))
        .when(F.col("_by_score"), F.col("readability_text"))
        .otherwise(generic),
    ).withColumn(
        "extractor_method",
        F.when(F.col("_by_site"), "site_specific")
        .when(F.col("_by_score"), "readability")
        .otherwise("generic_fallback"),
    )
    text = F.col("clean_content")
    rows = rows.select(
        "*", block_words(text).alias("word_count"), paragraph_count(text).alias("paragraph_count")
    )
    confidence = extraction_confidence(text, F.col("extractor_method"), F.col("word_count"))
    rows = rows.withColumn("extraction_confidence", confidence)
    rows = rows.withColumn("warning", quality_warning(F.col("extractor_method"), F.col("extraction_confidence")))
    info = formatting_info(text, F.col("word_count"), F.col("paragraph_count"))
    rows = rows.withColumn("formatting", F.struct(*[c.alias(n) for n, c in info.items()]))
    return rows.drop("_by_site", "_by_score", "_paragraphs")
