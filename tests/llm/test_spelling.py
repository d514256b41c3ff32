import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from galley.llm import spelling
from galley.llm.registry import op11_spelling_variants
from galley.llm.spelling import Letters, damaged, near_words, spelling_variants
from tests.llm.helpers import hard_documents, lower_ascii, no_documents, odd_documents

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def neighbours(words):
    """By trying out every letter left out; no length may be very long."""
    meet = defaultdict(set)
    for word in words:
        meet[word].add(word)
        for k in range(len(word)):
            meet[word[:k] + word[k + 1 :]].add(word)
            meet[word[:k] + "\0" + word[k + 1 :]].add(word)
    near = defaultdict(set)
    for group in meet.values():
        for a in group:
            near[a] |= {b for b in group if b != a and one_edit(a, b)}
    return near


def plain_variants(texts, one_in=97, least_n=3):
    n = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower_ascii(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {word: count for word, count in n.items() if len(word) >= 5 and count >= least_n}
    near, form = neighbours(n), {}
    for word, count in n.items():
        best = min(near[word], key=lambda w: (-n[w], w), default=None)
        form[word] = best if best is not None and n[best] >= 2 * count else None
    rows = []
    for word, count in n.items():
        root = word
        while form[root]:
            root = form[root]
        rows.append((word, form[word], root, count, len(near[word]), n.get(form[word])))
    return sorted(rows, key=repr)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select(COLUMNS).collect()), key=repr)


def test_all_documents(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    expected = plain_variants(texts)
    assert rows_of(op11_spelling_variants(spark, sf_dir)) == expected
    assert any(row[1] for row in expected) and any(row[2] != row[1] and row[1] for row in expected)


def test_odd_rows(spark):
    extra = [
        (20, "House house HOUSE house house house mouse mouse mouse housse housse housse"),
        (21, "äpfel äpfel äpfel Äpfel Äpfel Äpfel apfel apfel apfel ÷÷÷÷÷ ÷÷÷÷÷ ÷÷÷÷÷ ×÷÷÷÷ ×÷÷÷÷ ×÷÷÷÷"),
        (None, "abcde abcde abcde abcdef abcdef abcdef bacde bacde bacde"), (22, "abcde " * 30), (23, "abced " * 3),
    ]
    frame, texts = odd_documents(spark, extra)
    for one_in in (97, 2):
        assert rows_of(spelling_variants(frame, one_in=one_in)) == plain_variants(texts, one_in)
    assert spelling_variants(no_documents(spark)).count() == 0


def test_long_words(spark):
    frame, _ = hard_documents(spark)
    rows = spelling_variants(frame.union(frame).union(frame)).select("word", "n", "n_near").collect()
    assert {(len(r.word), r.n, r.n_near) for r in rows} == {(1_000_000, 3, 0), (600_000, 3, 0), (5, 3, 0)}


def test_chain_of_forms(spark):
    words = [("aaaaa" + "b" * k, 3 * 2**k) for k in range(12)]
    text = " ".join(word for word, n in words for _ in range(n))
    rows = {r.word: r for r in spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), one_in=10**12).collect()}
    assert {r.root for r in rows.values()} == {words[-1][0]}
    assert rows["aaaaa"].form == "aaaaab" and rows["aaaaab"].n_near == 2


def test_large_blocks_are_cut(spark, monkeypatch):
    """Words of two letters: a few blocks hold them all."""
    draw = np.random.default_rng(3)
    words = sorted({"".join(draw.choice(["a", "b"], 11)) for _ in range(1_500)})
    frame = spark.createDataFrame([(w, 3 + k % 7) for k, w in enumerate(words)], "word string, n long")
    near = neighbours(words)
    expected = sorted((a, b) for a in words for b in near[a])
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 100)
    assert spelling.large_blocks(frame).count() > 0
    found = near_words(frame)
    assert sorted((r.word, r.near) for r in found.collect()) == expected
    monkeypatch.setattr(spelling, "MAX_LARGE", -1)
    assert sorted((r.word, r.near) for r in near_words(frame).collect()) == expected


def test_one_edit():
    pairs = [("house", "mouse"), ("house", "housse"), ("house", "hhouse"), ("house", "houses"), ("house", "hosue"),
             ("house", "house"), ("house", "mousse"), ("aaaaa", "aaaaaa"), ("abcde", "bcdef")]
    letters = Letters([word for pair in pairs for word in pair])
    rows = np.arange(0, 2 * len(pairs), 2)
    assert letters.one_edit(rows, rows + 1).tolist() == [one_edit(a, b) for a, b in pairs]
    assert damaged("house", 97, 97) == "hose" and damaged("house", 98, 97) == "house"
