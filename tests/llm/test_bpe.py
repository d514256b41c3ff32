import hashlib
import random

import numpy as np
import pytest

from galley.llm.bpe import Decoder, Encoder, Transducer, decode_documents, encode_documents, merged, read_ranks, round_trip
from galley.llm.registry import BYTE_RANKS, op12_byte_bpe, vocabulary
from tests.llm.helpers import hard_documents, no_documents, odd_documents


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    ranks = read_ranks(vocabulary(BYTE_RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return np.array(ids, dtype="<u4").tobytes()


def digests(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_all_documents(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op12_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == digests(library, texts[row.doc_id])


def test_odd_rows(spark, library):
    frame, texts = odd_documents(spark)
    path = vocabulary(BYTE_RANKS)
    found = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in round_trip(frame, path).collect())
    assert found == sorted((d or 0, *digests(library, t)) for d, t in texts)
    assert round_trip(no_documents(spark), path).count() == 0
    encoded = encode_documents(frame, path).withColumnRenamed("n_tokens", "text")
    assert sorted((r.doc_id or 0, r.text) for r in decode_documents(encoded, path).collect()) == sorted((d or 0, t or "") for d, t in texts)


def test_long_runs(spark):
    frame, texts = hard_documents(spark)
    rows = round_trip(frame, vocabulary(BYTE_RANKS)).collect()
    sizes = {r.doc_id: r.decoded_sha256 for r in rows}
    assert sizes == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts}


def test_every_character_is_cut_as_the_library_cuts_it(library):
    encoder = Encoder(vocabulary(BYTE_RANKS))
    characters = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(characters), 500):
        text = "".join(f"a{c}b1{c}2  {c} {c}{c}." for c in characters[at : at + 500])
        assert encoder.encode(text) == packed(library.encode_ordinary(text))


def test_random_texts(library):
    encoder, draw = Encoder(vocabulary(BYTE_RANKS)), random.Random(7)
    decoder = Decoder(vocabulary(BYTE_RANKS))
    alphabets = ["".join(map(chr, range(128))), "ab", "etaoin shrdlu", "aeiou'stlm d", "éàüß漢字🙂", "0123456789 ", " \n\t \x1c", "#$%=-_*", "etaoinshrdluETAOIN"]
    for _ in range(4_000):
        text = "".join(draw.choices(draw.choice(alphabets), k=draw.randint(0, 60)))
        ids = encoder.encode(text)
        assert ids == packed(library.encode_ordinary(text))
        assert decoder.decode(ids) == text.encode()


def test_small_vocabularies_against_the_definition():
    draw = random.Random(11)
    for _ in range(300):
        tokens = [b"a", b"b", b"c"]
        for _ in range(draw.randint(1, 12)):
            new = draw.choice(tokens) + draw.choice(tokens)
            if new not in tokens:
                tokens.append(new)
        ranks = {token: k for k, token in enumerate(tokens)}
        try:
            transducer = Transducer(ranks)
            for _ in range(60):
                data = bytes(draw.choices(b"abc", k=draw.randint(0, 14)))
                assert transducer.ids(data) == packed([ranks[token] for token in merged(data, ranks)])
        except ValueError:
            # an entry may be merged from other parts than it was drawn from, and those may rank after it
            assert not in_order(ranks)


def in_order(ranks):
    return all(
        ranks[part] < ranks[token]
        for token in ranks if len(token) > 1
        for parts in [merged(token, ranks, until=2)] if len(parts) == 2
        for part in parts
    )


def test_vocabulary_out_of_order_is_refused():
    ranks = {b"a": 0, b"b": 1, b"aab": 2, b"ab": 3}
    with pytest.raises(ValueError):
        Transducer(ranks).ids(b"aab")
    assert in_order(read_ranks(vocabulary(BYTE_RANKS)))


def test_bounded_memory(monkeypatch, library):
    from galley.llm import bpe

    monkeypatch.setattr(bpe, "STATES", 50)
    monkeypatch.setattr(bpe, "MEMORY", 50)
    monkeypatch.setattr(bpe, "BESIDE", 50)
    encoder, draw = Encoder(vocabulary(BYTE_RANKS)), random.Random(3)
    for _ in range(40):
        text = "".join(draw.choices("etaoin shrdlu", k=400))
        assert encoder.encode(text) == packed(library.encode_ordinary(text))
        word = "".join(draw.choices("etaoinshrdlu", k=3_000))
        assert encoder.encode(word) == packed(library.encode_ordinary(word))


def test_streams_give_whole_characters(library):
    decoder, draw = Decoder(vocabulary(BYTE_RANKS)), random.Random(5)
    for _ in range(300):
        text = "".join(draw.choices("aé漢🙂🏳́ \U0010fffd퟿", k=draw.randint(0, 40)))
        ids = np.array(library.encode_ordinary(text), dtype="<u4")
        stream, parts, at = decoder.stream(), [], 0
        while at < len(ids):
            step = draw.randint(1, 4)
            parts.append(stream.feed(ids[at : at + step]).decode())
            at += step
        stream.close()
        assert "".join(parts) == text


def test_ids_that_are_no_text():
    decoder = Decoder(vocabulary(BYTE_RANKS))
    byte = {token[0]: rank for token, rank in read_ranks(vocabulary(BYTE_RANKS)).items() if len(token) == 1}

    def ids(*values):
        return packed([byte[v] for v in values])

    for bad in ([0x80], [0xC0, 0x80], [0xE0, 0x80, 0x80], [0xED, 0xA0, 0x80], [0xF0, 0x80, 0x80, 0x80], [0xF4, 0x90, 0x80, 0x80],
                [0xF5], [0xC3], [0xE2, 0x82], [0xC3, 0x28], [0xF0, 0x9F, 0x99]):
        with pytest.raises(ValueError):
            decoder.decode(ids(*bad))
    assert decoder.decode(ids(0xF0, 0x9F, 0x99, 0x82)) == "🙂".encode()
    with pytest.raises(IndexError):
        decoder.decode(packed([60_000]))
