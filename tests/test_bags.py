"""Key phrases and sentence scores by bags: rows against plain Python, and what they shuffle."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from galley.functions.flags import ENRICHMENTS
from galley.functions.lexicon import STOP_WORDS, WORDS
from galley.operators import bags, skew
from galley.operators.enrichment import batch_report, call_counts, enrich
from galley.operators.errors import feature_failures
from galley.operators.phrases import PHRASE, key_phrases, phrase_lists, top_phrases, topics
from galley.operators.summary import sentence_scores, top_sentences

TEXTS = "doc_id LONG, text STRING"
ODD = ["", " ", None, "...", "The of and", "İstanbul Çok. ÀÖØÞ ÷ßÿ K!\nñandú—niño", "a\0b zebra\0", "x" * 5000, "one. two!three?four\n\nfive six seven eight nine ten", "𝒳 river 😀 bridge. River bridge"]


def some_texts(n: int, seed: int = 7) -> list[tuple]:
    rng = random.Random(seed)
    words = [*STOP_WORDS[:8], *("".join(rng.choices("abcdeéñ", k=rng.randint(1, 6))) for _ in range(60))]
    made = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", ", ", ". ", "! ", "\n", " 7 "]) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return list(enumerate(ODD + made))


def plain_phrases(rows: list[tuple]) -> dict:
    found, held = {}, Counter()
    for key, text in rows:
        text = (text or "").lower()
        places = [(m.start(), m.group()) for m in re.finditer(WORDS, text)]
        grams = {}
        for i in range(len(places)):
            for n in (1, 2, 3):
                part = places[i : i + n]
                if len(part) < n or part[0][1] in STOP_WORDS or part[-1][1] in STOP_WORDS:
                    continue
                end = part[-1][0] + len(part[-1][1])
                if re.search(r"[.!?\n]", text[part[0][0] : end]):
                    continue
                entry = grams.setdefault(" ".join(w for _, w in part), [n, 0, part[0][0], end])
                entry[1] += 1
        found[key] = grams
        held.update(grams.keys())
    out = {}
    for key, grams in found.items():
        raw = {g: tf * math.log((len(rows) + 1) / (held[g] + 1)) for g, (_, tf, _, _) in grams.items()}
        best = max(raw.values(), default=0)
        out.update({(key, g): (n, raw[g] / best if best > 0 else 0.0, b, e) for g, (n, _, b, e) in grams.items()})
    return out


def plain_sentences(rows: list[tuple]) -> dict:
    split = {key: [(s, re.findall(WORDS, s.lower())) for s in re.split(r"[.!?\n]+", text or "")] for key, text in rows}
    tf = {key: Counter(w for _, words in parts for w in words if w not in STOP_WORDS) for key, parts in split.items()}
    df = Counter(w for words in tf.values() for w in words)
    out = {}
    for key, parts in split.items():
        for i, (sentence, words) in enumerate(parts):
            raw = [tf[key][w] * math.log((len(rows) + 1) / (df[w] + 1)) for w in words if w not in STOP_WORDS]
            if len(words) >= 5:
                out[key, i] = (sentence.strip(" "), sum(raw) / len(raw) if raw else 0.0)
    return out


def shuffled(frame) -> tuple[int, int]:
    """Rows and bytes a frame sends through exchanges when it is collected."""
    frame.collect()
    total = [0, 0]

    def walk(plan) -> None:
        name = plan.getClass().getSimpleName()
        if name == "ReusedExchangeExec":
            return
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        if name == "ShuffleExchangeExec":
            total[0] += plan.metrics().apply("shuffleRecordsWritten").value()
            total[1] += plan.metrics().apply("dataSize").value()
        children = plan.children()
        for k in range(children.size()):
            walk(children.apply(k))

    walk(frame._jdf.queryExecution().executedPlan())
    assert total[0] > 0
    return tuple(total)


def wordy(spark):
    """300 texts with over 500 grams each."""
    rng = random.Random(3)
    word = lambda: "w" + "".join(map(rng.choice, ("abcdefgh", "ijklmnop", "qrstu")))
    return spark.createDataFrame([(i, ". ".join(" ".join(word() for _ in range(25)) for _ in range(8))) for i in range(300)], TEXTS)


@pytest.mark.parametrize("parts", [1, 9])
def test_phrases_and_sentences_by_plain_python(spark, monkeypatch, parts):
    rows = some_texts(60)
    docs = spark.createDataFrame(rows, TEXTS)
    monkeypatch.setattr(skew, "PART_CHARS", -(-sum(len(t or "") for _, t in rows) // parts))
    found = {(r.doc_id, r.text): (r.n_words, r.confidence, r.begin_offset, r.end_offset) for r in key_phrases(docs).collect()}
    expected = plain_phrases(rows)
    assert found.keys() == expected.keys()
    for k, (n, confidence, begin, end) in expected.items():
        assert found[k][0] == n and found[k][2:] == (begin, end) and found[k][1] == pytest.approx(confidence, abs=1e-6)
    scored = {(r.doc_id, r.i): (r.sentence, r.score) for r in sentence_scores(docs).collect()}
    expected = plain_sentences(rows)
    assert scored.keys() == expected.keys()
    for k, (sentence, score) in expected.items():
        assert scored[k][0] == sentence and scored[k][1] == pytest.approx(score, abs=1e-6)


def test_phrase_lists_are_the_phrases_in_order(spark):
    docs = spark.createDataFrame([*some_texts(30), (3, "river bridge"), (None, "river bridge"), (None, "a bridge")], TEXTS)
    order = lambda p: (-p.confidence, p.begin_offset, p.end_offset)
    lists = {r.doc_id: r.phrases for r in phrase_lists(docs).collect()}
    flat = {}
    for r in key_phrases(docs).collect():
        flat.setdefault(r.doc_id, []).append(r)
    assert lists.keys() == flat.keys() and None in lists
    for k, phrases in flat.items():
        assert [[p[c] for c in PHRASE] for p in lists[k]] == [[p[c] for c in PHRASE] for p in sorted(phrases, key=order)]


def test_texts_without_words(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "of the")], TEXTS)
    for frame in (docs, docs.filter("doc_id < 0"), docs.filter("doc_id < 3")):
        assert [key_phrases(frame).count(), phrase_lists(frame).count(), sentence_scores(frame).count()] == [0, 0, 0]


def test_grams_are_no_rows_of_a_shuffle(spark):
    """A gram takes a few bytes of a shuffle, not several rows of one (F1)."""
    docs = wordy(spark)
    frame = key_phrases(docs)
    rows, size = shuffled(frame)
    grams = frame.count()
    assert rows < 2_000 < 100_000 < grams
    assert size - 2 * docs.agg(F.sum(F.length("text"))).first()[0] < 25 * grams


def test_only_the_best_phrases_travel_to_their_rank(spark):
    """No gram passes a join, and only the best ten of a text and task an exchange (F2)."""
    frame = top_phrases(key_phrases(wordy(spark)))
    assert not re.search("SortMergeJoin|Generate|collect_list", frame._jdf.queryExecution().executedPlan().toString())
    assert shuffled(frame)[0] < 6_000 and frame.count() == 3_000


def test_only_topics_travel_to_their_rank(spark):
    """No gram is a row of a shuffle on the way to the topics (F3)."""
    frame = topics(key_phrases(wordy(spark)))
    rows, _ = shuffled(frame)
    assert rows < 4_500 and 300 < frame.count() <= 1_500


def test_words_are_no_rows_of_a_shuffle(spark):
    """Sentences are scored in the bag of their text; only the best three of a text are shuffled again (F4)."""
    frame = top_sentences(sentence_scores(wordy(spark)))
    assert not re.search("SortMergeJoin|Generate|collect_list", frame._jdf.queryExecution().executedPlan().toString())
    assert shuffled(frame)[0] < 3_000 and frame.count() == 900


def flagged(spark):
    flags = [F.lit(True).alias(f) for f in ENRICHMENTS]
    return wordy(spark).select("doc_id", "text", *flags)


SMALL = {
    "call counts (F5)": call_counts,
    "topics (F6)": lambda rows: rows.select("doc_id", "topic_analysis.topics", F.size("topic_analysis.top_phrases").alias("n")),
    "failures (F7)": lambda rows: rows.select("doc_id", feature_failures(F.col("features_requested"), F.col("features_processed")).alias("failed")),
    "report (F8)": batch_report,
}


@pytest.mark.parametrize("name", SMALL)
def test_lists_of_phrases_travel_only_to_who_reads_them(spark, name):
    """Enriched texts are joined without the list of all their grams where nothing reads it."""
    frame = SMALL[name](enrich(flagged(spark)))
    rows, size = shuffled(frame)
    chars = wordy(spark).agg(F.sum(F.length("text"))).first()[0]
    # the text goes to its bag twice, once redacted to its key; grams and words go as hashes
    assert rows < 10_000 and size < 15 * chars


def test_enrichments_are_whole(spark):
    rows = enrich(flagged(spark)).orderBy("doc_id")
    assert "_has_topics" not in rows.columns
    held = {r.doc_id: [(p.text, p.confidence, p.begin_offset, p.end_offset) for p in r.phrases] for r in phrase_lists(wordy(spark)).collect()}
    for r in rows.collect():
        assert [tuple(p) for p in r.topic_analysis.key_phrases] == held[r.doc_id]
        assert [tuple(p) for p in r.topic_analysis.top_phrases] == held[r.doc_id][:10]
        assert sorted(r.features_processed) == sorted(ENRICHMENTS)


def test_a_term_is_counted_once_a_text_over_all_bags():
    """Also where two terms agree in the first 64 bits, in one bag or over several."""
    big = np.uint64((1 << 64) - 5)
    one = bags.Terms(np.array([7, big, 7], np.uint64), np.array([1, 2, 3], np.uint32), np.array([4, 1, 2]))
    two = bags.Terms(np.array([big, 7], np.uint64), np.array([9, 3], np.uint32), np.array([5, 70_000]))
    asked = pa.concat_tables([bags._asked(k, t, 3, np.uint16) for k, t in enumerate((one, two))])
    kinds = {n: asked[n].type for n in asked.column_names}
    assert kinds["_bag"] == pa.int64() and kinds["_shard"] == pa.int32() and set(asked["_shard"].to_pylist()) == {0, 2}
    answers = pa.concat_tables([bags._answered(asked.filter(pa.compute.equal(asked["_shard"], s)), np.uint16) for s in (2, 0)])
    of = lambda k: answers.filter(pa.compute.equal(answers["_bag"], k))
    assert bags._found(one, of(0)).tolist() == [4, 1, 70_002]
    assert bags._found(two, of(1)).tolist() == [5, 70_002]
    with pytest.raises(ValueError):
        bags._found(one, of(1))


def test_halves_go_up_as_in_spark(spark):
    rng = random.Random(5)
    values = [0.0, 0.5, 1.0, 1 / 128, 0.0000005, 0.0000015, 0.0000025, 2.0000005, 1234.5678905, 1 / 3, 2 / 3, 98765.4321985, *(rng.random() for _ in range(300)), *(rng.randint(0, 10**7) / 10**7 for _ in range(700))]
    rows = spark.createDataFrame([(v,) for v in values], "x DOUBLE").select("x", F.round("x", 6).alias("y")).collect()
    assert bags.half_up(np.array([r.x for r in rows])).tolist() == [r.y for r in rows]
