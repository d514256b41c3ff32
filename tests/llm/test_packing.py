import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from galley.llm.packing import AttentionCost, Encoder, assign, pack
from galley.llm.registry import BYTE_BPE, op1_packing, vocabulary
from tests.llm.helpers import hard_documents, no_documents, odd_documents


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(BYTE_BPE))


def check_pieces(rows, expected, capacity):
    """``expected``: the ids of every document by doc_id, ends included."""
    documents, sequences = defaultdict(list), defaultdict(list)
    for row in rows:
        documents[row.doc_id].append(row)
        sequences[row.sequence_id].append(row)
    assert set(documents) == set(expected)
    for doc_id, pieces in documents.items():
        ids, at = expected[doc_id], 0
        for piece in sorted(pieces, key=lambda p: p.start):
            assert piece.start == at and piece.doc_tokens == len(ids)
            part = np.array(ids[at : at + piece.length], dtype="<u4")
            assert len(part) == piece.length and zlib.crc32(part.tobytes()) == piece.ids_crc32
            at += piece.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for piece in sorted(pieces, key=lambda p: p.offset):
            assert piece.offset == at
            at += piece.length
        assert at <= capacity
    return len(sequences)


def test_all_documents(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = tokenizer()
    expected = {d: [*ids.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts.items()}
    used = check_pieces(op1_packing(spark, sf_dir).collect(), expected, 2048)
    total = sum(map(len, expected.values()))
    assert used * 2048 - total < 2048


def test_odd_rows(spark):
    frame, texts = odd_documents(spark)
    rows = pack(frame.coalesce(1), vocabulary(BYTE_BPE), end_id=1, capacity=64, keep_ids=True).collect()
    ids = tokenizer()
    unique = [r for r in rows if r.doc_id not in (None, 5)]
    expected = {d: [*ids.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts if d not in (None, 5)}
    by_doc = defaultdict(list)
    for row in sorted(unique, key=lambda r: r.start):
        by_doc[row.doc_id] += row.ids
    assert dict(by_doc) == expected
    assert sum(r.length for r in rows) == sum(len(ids.encode(t or "").ids) + 1 for _, t in texts)
    assert pack(no_documents(spark), vocabulary(BYTE_BPE), end_id=1).count() == 0


def test_long_runs(spark):
    frame, texts = hard_documents(spark)
    ids = tokenizer()
    rows = pack(frame, vocabulary(BYTE_BPE), end_id=1).select("doc_id", "length", "doc_tokens").collect()
    counts = defaultdict(int)
    for row in rows:
        counts[row.doc_id] += row.length
    assert counts == {d: len(ids.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts}


def test_encoder_equals_the_library():
    texts = ["a <|endoftext|> b", "it's  we'll\n\n x", "漢字 with latin", "tab\t\ttab ", "", " ", "\x1c\x1d a", "İ ſ é\u0301 ½ ²"]
    library = tokenizer()
    for text, ids in zip(texts, Encoder(vocabulary(BYTE_BPE)).encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 500), max_size=60))
def test_assign(lengths):
    capacity = 64
    pieces = assign(lengths, capacity, AttentionCost())
    covered, filled = defaultdict(list), defaultdict(list)
    for p in pieces:
        covered[p.document].append((p.start, p.start + p.length))
        filled[p.sequence].append((p.offset, p.offset + p.length))
    for document, length in enumerate(lengths):
        spans = sorted(covered[document])
        assert [s for s, _ in spans] == [0, *[e for _, e in spans[:-1]]] and spans[-1][1] == length
    for spans in filled.values():
        spans = sorted(spans)
        assert [s for s, _ in spans] == [0, *[e for _, e in spans[:-1]]] and spans[-1][1] <= capacity
    assert len(filled) * capacity - sum(lengths) < capacity


def test_costs_are_balanced():
    lengths = [500, 400, 300, 300, 248, 200]
    cost = AttentionCost(quadratic=1 / 1024)
    pieces = assign(lengths, 1024, cost)
    assert all(p.length == lengths[p.document] for p in pieces)
    totals = defaultdict(float)
    for p in pieces:
        totals[p.sequence] += cost.of(p.length)
    assert max(totals.values()) < 1.2 * min(totals.values())
