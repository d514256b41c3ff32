import math
import zlib
from collections import Counter

import numpy as np

from galley.llm.lm import GROUPS, SIZE, MaxEnt, context_features, score_documents, train
from tests.llm.helpers import WORD, lower_ascii, no_documents, odd_documents


def tokens(text):
    return [*WORD.findall(lower_ascii(text)), None]


def is_held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def check_base(rows, texts):
    counts = Counter(t for d, text in texts if not is_held(d) for t in tokens(text))
    total = sum(counts.values())
    expected = []
    for doc_id, text in texts:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (total + len(counts) + 1)) for t in own)
        expected.append((str(doc_id), is_held(doc_id), len(own), sum(counts[t] > 0 for t in own), total, round(base, 5)))
    found = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows]
    assert sorted(found) == sorted(expected)
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)


def test_odd_rows(spark):
    frame, texts = odd_documents(spark, [(k, f"a common text with number {k}") for k in range(20, 60)])
    check_base(score_documents(frame).collect(), texts)
    check_base(score_documents(frame, held_words=20).collect(), texts)
    assert score_documents(no_documents(spark)).count() == 0
    alone = spark.createDataFrame([(k, "all held out") for k in range(200) if is_held(k)], "doc_id long, text string")
    assert {(r.n_known, r.train_tokens) for r in score_documents(alone).collect()} == {(0, 0)}


def test_model_beats_unigrams_on_held_out_texts(spark):
    folder = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    rows = score_documents(documents, held_words=2_000).collect()
    check_base(rows, [(r.doc_id, r.text) for r in documents.collect()])
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one():
    draw = np.random.default_rng(0)
    model = MaxEnt.from_counts(draw.integers(0, 100, GROUPS * SIZE).astype(float))
    outcomes = draw.integers(0, GROUPS * SIZE, 300)
    features = context_features(outcomes, np.array([0, 100]))
    before = model.log10(outcomes, features).sum()
    for _ in range(5):
        train(model, [(outcomes, features)])
    assert model.log10(outcomes, features).sum() > before
    every = np.arange(GROUPS * SIZE)
    assert abs((10 ** model.log10(every, np.repeat(features[7:8], len(every), axis=0))).sum() - 1) < 1e-4


def test_contexts_end_at_texts():
    outcomes = np.array([1, 2, 3, 1, 2, 3])
    features = context_features(outcomes, np.array([0, 3]))
    assert np.array_equal(features[:3], features[3:])


def test_every_training_position_gives_an_update(spark, monkeypatch):
    texts = [(k, " ".join(f"w{k}" for _ in range(k % 5))) for k in range(40)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    seen, group_by = [], type(frame).groupBy

    def tap(self, *columns):
        if [c for c in columns if isinstance(c, str)] == ["piece"]:
            seen.append(self.filter("piece = 0").selectExpr("sum(seen)").first()[0])
        return group_by(self, *columns)

    monkeypatch.setattr(type(frame), "groupBy", tap)
    score_documents(frame).collect()
    assert sum(seen) == sum(len(tokens(text)) for k, text in texts if not is_held(k))
