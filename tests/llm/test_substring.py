import random

import numpy as np
from pyspark.sql import functions as F

from galley.llm.substring import anchored_runs, remove_repeats, rolling, word_hashes
from tests.llm.helpers import WORD, no_documents, odd_documents


def brute(keyed, length):
    """Kept words by key, for (key, text) in the order of the keys."""
    seen, kept = set(), {}
    for key, text in keyed:
        words = WORD.findall(text or "")
        covered = [False] * len(words)
        for i in range(len(words) - length + 1):
            window = tuple(words[i : i + length])
            if window in seen:
                covered[i : i + length] = [True] * length
            seen.add(window)
        kept[key] = [w for w, gone in zip(words, covered, strict=True) if not gone]
    return kept


def planted(seed, documents=70):
    """Few words, so anchors are common; shared passages of all lengths, copies, and loops."""
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    passages = [draw.choices(words, k=n) for n in (8, 12, 19, 20, 21, 25, 40, 90)]
    texts = []
    for _ in range(documents):
        parts = []
        for _ in range(draw.randint(0, 6)):
            parts += draw.choice(passages) if draw.random() < 0.6 else draw.choices(words, k=draw.randint(1, 40))
        if draw.random() < 0.1:
            parts += ["a"] * draw.randint(1, 60)
        texts.append(" ".join(parts))
    texts += texts[:5]
    return [(k * 3, t) for k, t in enumerate(texts)]


def test_planted_passages(spark):
    for seed in (1, 2):
        rows = planted(seed)
        frame = spark.createDataFrame(random.Random(9).sample(rows, len(rows)), "doc_id long, text string").repartition(5)
        for length in (20, 12):
            expected = brute(rows, length)
            for r in remove_repeats(frame, length).collect():
                words = WORD.findall(r.text)
                kept = expected[r.doc_id]
                assert (r.n_words, r.n_removed, r.kept_text) == (len(words), len(words) - len(kept), " ".join(kept))


def test_common_anchors_are_salted(spark):
    """A passage shorter than a window in most documents, each time in other words."""
    shared = " ".join(f"common{k}" for k in range(15))
    rows = [(k, " ".join(f"l{k}x{j}" for j in range(12)) + f" {shared} " + " ".join(f"r{k % 40}x{j}" for j in range(12))) for k in range(1200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = brute(rows, 20)
    found = {r.doc_id: r.kept_text for r in remove_repeats(frame).collect()}
    assert found == {k: " ".join(w) for k, w in expected.items()}


def test_odd_rows(spark):
    passage = " ".join(f"p{k}" for k in range(25))
    extra = [(50, passage), (50, passage), (51, passage + " tail"), (None, passage), (-3, "a head " + passage)]
    frame, texts = odd_documents(spark, extra)
    rows = remove_repeats(frame).collect()
    assert len(rows) == len(texts)
    found = {(r.doc_id, r.text): (r.n_words, r.n_removed, r.kept_text) for r in rows}
    assert found[-3, "a head " + passage] == (27, 0, "a head " + passage)
    assert found[50, passage] == (25, 25, "") and found[None, passage] == (25, 25, "")
    assert found[51, passage + " tail"] == (26, 25, "tail")
    assert found[2, None] == found[3, ""] == (0, 0, "") and found[5, "same row"] == (2, 0, "same row")
    assert remove_repeats(no_documents(spark)).count() == 0


def test_rolling_hashes_equal_for_equal_runs():
    words = [b"a", b"b", b"c", b"d"] * 20
    for length in (1, 2, 3, 8, 20, 27):
        found = rolling(word_hashes(words), length, 0x9FB21C651E98DF25)
        assert len(found) == len(words) - length + 1
        assert np.array_equal(found[:-4], found[4:]) and len(set(found.tolist())) == 4


def test_every_window_is_in_one_run():
    draw = random.Random(1)
    words = [str(draw.randrange(50)).encode() for _ in range(500)]
    sizes = np.array([0, 19, 20, 0, 300, 161])
    _, _, first, count = anchored_runs(word_hashes(words), sizes, 20)
    windows = [w for a, n in zip(first.tolist(), count.tolist(), strict=True) for w in range(a, a + n)]
    ends = np.cumsum(sizes)
    assert windows == [w for size, end in zip(sizes.tolist(), ends.tolist(), strict=True) for w in range(end - size, end - 19)]


def test_no_all_to_one_exchange(spark):
    frame = spark.createDataFrame(planted(3), "doc_id long, text string")
    plan = remove_repeats(frame).select(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
