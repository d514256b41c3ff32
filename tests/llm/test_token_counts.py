import random

import sentencepiece

from galley.llm.registry import PIECE_BPE, op3_token_counts, vocabulary
from galley.llm.token_counts import Counter, token_counts, whole_tokens
from tests.llm.helpers import hard_documents, no_documents, odd_documents


def library():
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE_BPE))


def test_all_documents(spark, sf_dir):
    model = library()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op3_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row.doc_id] or ""
        n = len(model.encode(text))
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), n, n > 4096)


def test_odd_rows(spark):
    frame, texts = odd_documents(spark)
    model = library()
    rows = token_counts(frame, vocabulary(PIECE_BPE)).collect()
    found = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rows)
    assert found == sorted((d or 0, len((t or "").encode()), len(model.encode(t or ""))) for d, t in texts)
    assert token_counts(no_documents(spark), vocabulary(PIECE_BPE)).count() == 0


def test_segments_count_as_the_library_does():
    model, counter = library(), Counter(vocabulary(PIECE_BPE))
    alphabet = ["a", "the", " ", "  ", "▁", "\n", "\t", "é", "ß", "漢", "1", "23", "</s>", "<s>", "<unk>", "<0x0A>", ".", "\u00a0", "🙂"]
    draw = random.Random(5)
    texts = ["", " ", "▁", *["".join(draw.choices(alphabet, k=draw.randint(1, 12))) for _ in range(3_000)]]
    assert counter.count(texts) == [len(ids) for ids in model.encode(texts)]


def test_whole_tokens_are_proved():
    model = library()
    whole = whole_tokens(model)
    assert len(whole) > 10_000
    assert all(len(model.encode(word)) == 1 for word in list(whole)[:2_000])


def test_long_runs(spark):
    frame, texts = hard_documents(spark, words=50_000)
    model = library()
    found = {r.doc_id: r.n_tokens for r in token_counts(frame, vocabulary(PIECE_BPE)).collect()}
    assert found == {d: len(model.encode(t)) for d, t in texts}
