"""Registered text queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs
from checks import oracle_text as o
from galley.functions import text as t
from galley.operators.normalization import normalization_errors, normalize_corpus
from galley.operators.normalized_store import NormalizedStore
from galley.session import new_path
from galley.operators.phrases import key_phrases, top_phrases, topics
from galley.operators.pii import pii_entities, redact
from galley.operators.scoring import score_with
from galley.operators.sentiment import sentiment, sentiment_eval
from galley.operators.summary import sentence_scores, summarize, summary_errors, top_sentences


def _docs(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents")


def _turns(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "conversations")
    return rows.select(F.concat_ws("-", "conv_id", "turn").alias("turn_id"), "text")


SPOILED = "concat(text, chr(1), chr(7), substr(text, 1, 40), chr(127))"


def p7_sanitize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.sanitize_text(F.expr(SPOILED)).alias("text"))


def p8_truncate_bytes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.truncate_bytes(F.col("text")).alias("text"))


def p9_eligible_texts(spark, sf_dir):
    text = F.expr("CASE WHEN doc_id % 20 = 0 THEN ' ' WHEN doc_id % 20 = 1 THEN repeat(text, 400) ELSE text END")
    rows = _docs(spark, sf_dir).select("doc_id", text.alias("text"))
    return rows.select(
        "doc_id",
        t.eligible_for_llm(F.col("text")).alias("eligible"),
        t.eligibility_error(F.col("text")).alias("message"),
    )


def p10_clean_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.clean_text(F.col("text")).alias("text"))


def p11_clean_block(spark, sf_dir):
    text = F.expr("CASE WHEN doc_id % 4 = 0 THEN concat(' Related: ', text) ELSE text END")
    return _docs(spark, sf_dir).select("doc_id", t.clean_block(text).alias("text"))


def p12_text_metrics(spark, sf_dir):
    text = F.replace("text", F.lit(".\n"), F.lit(".\n\n"))
    return _docs(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in t.text_metrics(text).items()])


def p13_good_content(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.is_good_content(F.col("text")).alias("good"))


def p19_compression_ratio(spark, sf_dir):
    text = F.expr("CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END")
    ratio = t.compression_ratio(F.length(t.clean_text(text)), F.length(text))
    return _docs(spark, sf_dir).select("doc_id", F.round(ratio, 6).alias("ratio"))


def e1_sentiment(spark, sf_dir):
    return sentiment(_docs(spark, sf_dir))


def e1_sentiment_turns(spark, sf_dir):
    return sentiment(_turns(spark, sf_dir), "turn_id")


def e2_pii_entities(spark, sf_dir):
    return pii_entities(_docs(spark, sf_dir))


def e2_pii_entities_turns(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "conversations")
    text = F.expr(_TURN_TEXT.replace("{text}", "STRING")).alias("text")
    return pii_entities(rows.select(F.concat_ws("-", "conv_id", "turn").alias("turn_id"), text), "turn_id")


def e3_redact(spark, sf_dir):
    return redact(_docs(spark, sf_dir)).withColumn("pii_types", F.array_join("pii_types", ","))


def e4_key_phrases(spark, sf_dir):
    return key_phrases(_docs(spark, sf_dir))


def e4_key_phrases_items(spark, sf_dir):
    return key_phrases(inputs.table(spark, sf_dir, "benchmark"), "item_id")


def w6_top_phrases(spark, sf_dir):
    return top_phrases(key_phrases(_docs(spark, sf_dir)))


def w7_topics(spark, sf_dir):
    return topics(key_phrases(_docs(spark, sf_dir)))


def w8_top_sentences(spark, sf_dir):
    docs = _docs(spark, sf_dir).filter(~t.is_blank(F.col("text")))
    return top_sentences(sentence_scores(docs)).select("doc_id", "i", "sentence", "score", "rank")


def e5_summarize(spark, sf_dir):
    return summarize(_docs(spark, sf_dir))


def e5_summary_errors(spark, sf_dir):
    text = F.expr("CASE WHEN doc_id % 20 = 0 THEN ' ' WHEN doc_id % 20 = 1 THEN repeat(text, 400) ELSE text END")
    return summary_errors(_docs(spark, sf_dir).withColumn("text", text), limit=t.LLM_LIMIT)


def e6_normalize_corpus(spark, sf_dir):
    return normalize_corpus(_docs(spark, sf_dir))


def e6_normalization_errors(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("text", F.expr(_SPOILED)).withColumn("source", F.expr(_LOST_SOURCE))
    return normalization_errors(docs, limit=t.LLM_LIMIT)


def e6_normalize_in_batches(spark, sf_dir):
    """Four batches: two thirds of the texts as they were before, the last third, and then the present texts of the rest."""
    docs = _docs(spark, sf_dir).select("doc_id", "text", "source")
    third = F.col("doc_id") % 3
    before = F.concat(F.col("text"), F.lit("\na line of the older version\n"), F.substring("text", 1, 40))
    older = docs.withColumn("text", F.when(F.col("doc_id") % 5 > 0, before).otherwise(F.lit("  ")))
    store = NormalizedStore(spark, new_path(spark, "normalized"))
    for number, batch in enumerate((older.filter(third == 0), older.filter(third == 1), docs.filter(third == 2), docs.filter(third < 2))):
        store.update(batch, number)
    return store.read()


def e6_normalize_lost_sources(spark, sf_dir):
    return normalize_corpus(_docs(spark, sf_dir).withColumn("source", F.expr(_LOST_SOURCE)))


def vowel_share(part):
    """A stand-in for a model of the user's; it refuses texts with a digit."""
    if part["text"].str.contains("[0-9]").any():
        raise ValueError("digits are not supported")
    share = part["text"].str.count("[aeiou]") / part["text"].str.len()
    return part.assign(share=share.round(6))


def e7_score_with(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", "text")
    return score_with(rows, vowel_share, "share DOUBLE")


def e8_sentiment_eval(spark, sf_dir):
    return sentiment_eval(sentiment(_docs(spark, sf_dir)), inputs.table(spark, sf_dir, "labels"))


_LOST_SOURCE = "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END"
_SPOILED = (
    "CASE WHEN doc_id % 20 = 0 THEN ' ' WHEN doc_id % 20 = 1 THEN repeat(text, 400) "
    "WHEN doc_id % 20 < 9 THEN 'Same line.' ELSE text END"
)
#: Turns with an address, a number and a name put in, so that there is something to find.
_TURN_TEXT = (
    "concat(text, CASE turn % 4 WHEN 0 THEN concat(' Mail to user', conv_id, '@mail.example.com please.') "
    "WHEN 1 THEN concat(' Call +1 (212) 555-', lpad(CAST(conv_id % 10000 AS {text}), 4, '0'), ' now.') "
    "WHEN 2 THEN ' From 10.1.2.3 only.' ELSE '' END)"
)

QUERIES = {
    name: f
    for name, f in list(globals().items())
    if callable(f) and getattr(f, "__module__", None) == __name__ and name[0] in "pew" and name[1].isdigit()
}

_TURNS = "(SELECT concat(conv_id, '-', turn) AS turn_id, text FROM conversations)"
_SHOWN_TURNS = f"(SELECT concat(conv_id, '-', turn) AS turn_id, {_TURN_TEXT.replace('{text}', 'VARCHAR')} AS text FROM conversations)"
_VOWELS = "length(regexp_replace(text, '[^aeiou]', '', 'g'))"
_SPOILED9 = "CASE WHEN doc_id % 20 = 0 THEN ' ' WHEN doc_id % 20 = 1 THEN repeat(text, 400) ELSE text END"
_REASON = f"CASE WHEN NOT regexp_matches(text, {o.q(o.WORD)}) THEN 'Text cannot be empty' WHEN length(text) > 100000 THEN 'Text too long' END"

ORACLE = {
    "p7_sanitize_text": "SELECT doc_id, concat(text, substr(text, 1, 40)) AS text FROM documents",
    "p8_truncate_bytes": """SELECT doc_id, CASE WHEN strlen(text) <= 5000 THEN text ELSE substr(text, 1, (
        SELECT max(n) FROM range(1250, 5001) r(n) WHERE strlen(substr(text, 1, n)) <= 5000)::INT) END AS text FROM documents""",
    "p9_eligible_texts": f"SELECT doc_id, message IS NULL AS eligible, message FROM (SELECT doc_id, {_REASON} AS message FROM (SELECT doc_id, {_SPOILED9} AS text FROM documents))",
    "p10_clean_text": f"SELECT doc_id, {o.clean_text('text')} AS text FROM documents",
    "p11_clean_block": f"SELECT doc_id, {o.clean_block('x')} AS text FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN concat(' Related: ', text) ELSE text END AS x FROM documents)",
    "p12_text_metrics": f"""SELECT doc_id, {o.words('x')} AS word_count, length(x) AS char_count, strlen(x) AS byte_count,
        len(list_filter(string_split(x, chr(10) || chr(10)), lambda p: regexp_matches(p, {o.q(o.WORD)}))) AS paragraph_count
        FROM (SELECT doc_id, replace(text, '.' || chr(10), '.' || chr(10) || chr(10)) AS x FROM documents)""",
    "p13_good_content": f"SELECT doc_id, {o.good('text')} AS good FROM documents",
    "p19_compression_ratio": f"SELECT doc_id, CASE WHEN length(x) = 0 THEN 0 ELSE round(length({o.clean_text('x')}) / length(x), 6) END AS ratio FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END AS x FROM documents)",
    "e1_sentiment": o.sentiment(),
    "e1_sentiment_turns": o.sentiment(_TURNS, "turn_id"),
    "e2_pii_entities": o.pii_entities(),
    "e2_pii_entities_turns": o.pii_entities(_SHOWN_TURNS, "turn_id"),
    "e3_redact": o.redact(),
    "e4_key_phrases": o.grams() + " SELECT * FROM kp",
    "e4_key_phrases_items": o.grams("benchmark", "item_id") + " SELECT * FROM kp",
    "w6_top_phrases": o.grams() + " " + o.ranked("", 10),
    "w7_topics": o.grams() + f" SELECT doc_id, rank, {o.TITLE} AS topic FROM ({o.ranked('WHERE confidence > 0.8', 5)})",
    "w8_top_sentences": o.sentences("documents") + " SELECT k AS doc_id, i, sentence, score, rank FROM tp",
    "e5_summarize": o.sentences("documents") + " SELECT * FROM sm",
    "e5_summary_errors": f"SELECT doc_id, {_REASON} AS message FROM (SELECT doc_id, {_SPOILED9} AS text FROM documents) WHERE {_REASON} IS NOT NULL",
    "e6_normalize_corpus": o.NORMALIZED + " SELECT doc_id, normalized_text, original_length, length(normalized_text) AS normalized_length, round(length(normalized_text) / original_length, 6) AS compression_ratio FROM nm WHERE normalized_text <> ''",
    "e6_normalize_in_batches": o.NORMALIZED + " SELECT doc_id, normalized_text, original_length, length(normalized_text) AS normalized_length, round(length(normalized_text) / original_length, 6) AS compression_ratio FROM nm WHERE normalized_text <> ''",
    "e6_normalization_errors": f"WITH sp AS (SELECT doc_id, {_SPOILED} AS text, {_LOST_SOURCE} AS source FROM documents) SELECT * FROM ({o.normalized('sp', limit=100_000)} SELECT doc_id, 'Empty normalized text' AS message FROM nm WHERE normalized_text = '') UNION ALL SELECT doc_id, {_REASON} FROM sp WHERE {_REASON} IS NOT NULL",
    "e6_normalize_lost_sources": o.normalized(f"(SELECT * REPLACE ({_LOST_SOURCE} AS source) FROM documents)") + " SELECT doc_id, normalized_text, original_length, length(normalized_text) AS normalized_length, round(length(normalized_text) / original_length, 6) AS compression_ratio FROM nm WHERE normalized_text <> ''",
    "e7_score_with": f"""SELECT doc_id, CASE WHEN bad THEN NULL WHEN length(text) = 0 THEN NULL ELSE round({_VOWELS} / length(text), 6) END AS share,
        CASE WHEN bad THEN 'ValueError' END AS error_type, CASE WHEN bad THEN 'digits are not supported' END AS error_message
        FROM (SELECT *, regexp_matches(text, '[0-9]') AS bad FROM documents)""",
    "e8_sentiment_eval": f"SELECT toxic, sentiment, count(*) AS n FROM ({o.sentiment()}) JOIN labels USING (doc_id) GROUP BY ALL",
}
