"""SQL for the enrichment operators."""

from __future__ import annotations

from checks.oracle_html import WORD, clean_block, clean_text, collapse, good, names, q, words
from galley.functions.lexicon import NEGATIVE, POSITIVE, STOP_WORDS

LETTER = "a-zà-öø-ÿ"
PATTERNS = (
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("IP_ADDRESS", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    ("CREDIT_DEBIT_NUMBER", r"[0-9]{16}"),
    ("PHONE", r"\+?[0-9]{1,2} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
)


def sentiment(source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return f"""SELECT {key}, sentiment, positive, negative, neutral, mixed,
      CASE sentiment WHEN 'POSITIVE' THEN positive WHEN 'NEGATIVE' THEN negative WHEN 'MIXED' THEN mixed ELSE neutral END AS dominant_confidence
    FROM (SELECT {key}, CASE WHEN p = 0 AND n = 0 THEN 'NEUTRAL' WHEN least(p, n) > 0 AND 2 * least(p, n) >= greatest(p, n) THEN 'MIXED'
        WHEN p > n THEN 'POSITIVE' ELSE 'NEGATIVE' END AS sentiment,
      round(greatest(p - n, 0) / w, 6) AS positive, round(greatest(n - p, 0) / w, 6) AS negative,
      round((w - p - n) / w, 6) AS neutral, round(2 * least(p, n) / w, 6) AS mixed
    FROM (SELECT {key}, count(*) AS w, count(*) FILTER (word IN ({names(POSITIVE)})) AS p,
        count(*) FILTER (word IN ({names(NEGATIVE)})) AS n
      FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[{LETTER}]+')) AS word FROM {source}) GROUP BY ALL))"""


def _pii_chain(source: str, key: str, text: str) -> str:
    """CTEs m0..m4: texts with the types of higher priority masked by equal-length filler."""
    out = [f"m0 AS (SELECT {key}, {text} AS t FROM {source})"]
    for i, (_, p) in enumerate(PATTERNS):
        out.append(
            f"m{i + 1} AS (SELECT {key}, array_to_string(list_transform(string_split_regex(t, {q(p)}), "
            f"lambda x, k: concat(x, repeat(chr(1), coalesce(length(regexp_extract_all(t, {q(p)})[k]), 0)))), '') AS t FROM m{i})"
        )
    return "WITH " + ", ".join(out)


def pii_entities(source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    parts = []
    for i, (name, p) in enumerate(PATTERNS):
        parts.append(
            f"SELECT {key}, '{name}' AS type, hits[k] AS text, CAST(1.0 AS DOUBLE) AS confidence, "
            f"list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k-1], lambda x: length(x))), 0) AS begin_offset "
            f"FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM (SELECT {key}, string_split_regex(t, {q(p)}) AS gaps, "
            f"regexp_extract_all(t, {q(p)}) AS hits FROM m{i} WHERE regexp_matches(t, {q(p)})))"
        )
    return (
        _pii_chain(source, key, text)
        + f" SELECT {key}, type, text, confidence, begin_offset::INT AS begin_offset, (begin_offset + length(text))::INT AS end_offset FROM ("
        + " UNION ALL ".join(parts)
        + ")"
    )


def redact(source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    x = text
    for name, p in PATTERNS:
        x = f"regexp_replace({x}, {q(p)}, '[{name}]', 'g')"
    kinds = ", ".join(
        f"(SELECT CASE WHEN regexp_matches(t, {q(p)}) THEN '{name}' END FROM m{i} WHERE m{i}.{key} = d.{key})"
        for i, (name, p) in enumerate(PATTERNS)
    )
    return (
        _pii_chain(source, key, text)
        + f" SELECT {key}, redacted_text, len(l) > 0 AS has_pii, array_to_string(l, ',') AS pii_types FROM (SELECT {key}, {x} AS redacted_text, "
        + f"list_sort(list_filter([{kinds}], lambda v: v IS NOT NULL)) AS l FROM {source} d)"
    )


def grams(source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTEs sw (words by sentence) .. kp (key phrases)."""
    stop = names(STOP_WORDS)
    return f"""WITH pc AS MATERIALIZED (
  SELECT {key} AS k, generate_subscripts(l, 1) AS i, unnest(l) AS piece
  FROM (SELECT {key}, regexp_extract_all(lower({text}), '[{LETTER}]+|[^{LETTER}]+') AS l FROM {source})),
ws AS (
  SELECT k, i, piece AS word, coalesce(sum(length(piece)) OVER w, 0) AS b,
    coalesce(sum(CASE WHEN regexp_matches(piece, '[.!?\\n]') THEN 1 ELSE 0 END) OVER w, 0) AS s
  FROM pc WINDOW w AS (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
wd AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) AS r FROM ws WHERE regexp_matches(word, '^[{LETTER}]')),
g AS (
  SELECT k, word AS gram, 1 AS n, b, b + length(word) AS e FROM wd WHERE word NOT IN ({stop})
  UNION ALL SELECT a.k, a.word || ' ' || c.word, 2, a.b, c.b + length(c.word) FROM wd a JOIN wd c ON c.k = a.k AND c.r = a.r + 1 AND c.s = a.s
    WHERE a.word NOT IN ({stop}) AND c.word NOT IN ({stop})
  UNION ALL SELECT a.k, a.word || ' ' || m.word || ' ' || c.word, 3, a.b, c.b + length(c.word) FROM wd a JOIN wd m ON m.k = a.k AND m.r = a.r + 1
    JOIN wd c ON c.k = a.k AND c.r = a.r + 2 AND c.s = a.s WHERE a.word NOT IN ({stop}) AND c.word NOT IN ({stop})),
tf AS MATERIALIZED (SELECT k, gram, n, count(*) AS tf, min(b) AS b, arg_min(e, b) AS e FROM g GROUP BY ALL),
df AS (SELECT gram, count(*) AS df FROM tf GROUP BY ALL),
rw AS MATERIALIZED (SELECT tf.*, tf * ln((1.0 + (SELECT count(*) FROM {source})) / (1.0 + df)) AS raw FROM tf JOIN df USING (gram)),
kp AS MATERIALIZED (SELECT k AS {key}, gram AS text, n AS n_words, round(CASE WHEN max(raw) OVER (PARTITION BY k) > 0 THEN raw / max(raw) OVER (PARTITION BY k) ELSE 0 END, 6) AS confidence,
  CAST(b AS BIGINT) AS begin_offset, CAST(e AS BIGINT) AS end_offset FROM rw)"""


def ranked(where: str, limit: int, key: str = "doc_id") -> str:
    return (
        f"SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY confidence DESC, begin_offset, end_offset) AS rank "
        f"FROM kp {where} QUALIFY rank <= {limit}"
    )


TITLE = "array_to_string(list_transform(string_split(text, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def sentences(source: str, key: str = "doc_id", text: str = "text") -> str:
    stop = names(STOP_WORDS)
    return f"""WITH us AS MATERIALIZED (SELECT {key} AS k, {text} AS t FROM {source} WHERE regexp_matches({text}, {q(WORD)})),
sn AS MATERIALIZED (SELECT k, generate_subscripts(l, 1) - 1 AS i, trim(unnest(l)) AS sentence FROM (SELECT k, string_split_regex(t, '[.!?\\n]+') AS l FROM us)),
sw AS MATERIALIZED (SELECT k, i, word FROM (SELECT k, i, unnest(regexp_extract_all(lower(sentence), '[{LETTER}]+')) AS word FROM sn) WHERE word NOT IN ({stop})),
wt AS (SELECT k, word, count(*) AS tf FROM sw GROUP BY ALL),
wf AS (SELECT word, count(*) AS df FROM wt GROUP BY ALL),
wr AS (SELECT k, word, tf * ln((1.0 + (SELECT count(*) FROM us)) / (1.0 + df)) AS raw FROM wt JOIN wf USING (word)),
sc AS MATERIALIZED (SELECT sn.k, sn.i, sn.sentence, round(coalesce(x.score, 0), 6) AS score FROM sn LEFT JOIN
  (SELECT sw.k, sw.i, avg(raw) AS score FROM sw JOIN wr ON wr.k = sw.k AND wr.word = sw.word GROUP BY ALL) x ON x.k = sn.k AND x.i = sn.i
  WHERE len(regexp_extract_all(lower(sn.sentence), '[{LETTER}]+')) >= 5),
tp AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, i) AS rank FROM sc QUALIFY rank <= 3),
sm AS MATERIALIZED (SELECT {key}, summary, original_length, length(summary) AS summary_length, round(length(summary) / original_length, 6) AS compression_ratio FROM (
  SELECT us.k AS {key}, coalesce(x.s, '') AS summary, length(us.t) AS original_length FROM us LEFT JOIN
  (SELECT k, string_agg(sentence, '. ' ORDER BY i) || '.' AS s FROM tp GROUP BY ALL) x ON x.k = us.k))"""


def normalized(
    source: str = "documents", key: str = "doc_id", text: str = "text", site: str = "source", limit: int | None = None
) -> str:
    short = f"length({text}) <= {limit} AND " if limit else ""
    return f"""WITH us AS MATERIALIZED (SELECT {key} AS k, {site} AS site, {text} AS t FROM {source} WHERE {short}regexp_matches({text}, {q(WORD)})),
ln AS MATERIALIZED (SELECT k, site, line, min(i) AS i FROM (SELECT k, site, generate_subscripts(l, 1) AS i, trim(unnest(l)) AS line FROM
  (SELECT k, site, string_split(t, chr(10)) AS l FROM us)) WHERE line <> '' GROUP BY ALL),
cm AS (SELECT site, line FROM ln GROUP BY ALL HAVING count(*) >= 5),
nm AS MATERIALIZED (SELECT us.k AS {key}, length(us.t) AS original_length, coalesce(x.t, '') AS normalized_text FROM us LEFT JOIN (
  SELECT k, string_agg(line, chr(10) ORDER BY i) AS t FROM ln WHERE NOT EXISTS (SELECT 1 FROM cm WHERE cm.site IS NOT DISTINCT FROM ln.site AND cm.line = ln.line) GROUP BY ALL) x ON x.k = us.k)"""


NORMALIZED = normalized()
