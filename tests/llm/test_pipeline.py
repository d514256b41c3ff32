from collections import Counter

import corpus_pipeline
from galley.llm import registry
from galley.llm.decontamination import tokens_of
from galley.llm.registry import BYTE_BPE, vocabulary
from galley.session import new_path
from tests.llm.helpers import WORD
from tests.llm.test_packing import check_pieces, tokenizer
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_substring import brute


def test_stages_against_plain_python(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, tables = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, f"test-{name}")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        assert name == "packing" or docs.columns == columns
        tables.append(docs.collect())
    given, civil, single, unrepeated, clean, pieces = tables

    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    gone = {r.doc_id for r in given} - {r.doc_id for r in civil}
    known = Counter(labels[d] for d in gone if d in labels)
    assert known[0] <= 0.1 * sum(labels[r.doc_id] == 0 for r in given if r.doc_id in labels)

    prints = {r.doc_id: plain_fingerprint(r.text) for r in civil}
    of = sorted(set(prints.values()))
    root = plain_components(of, [(a, b) for i, a in enumerate(of) for b in of[i + 1 :] if (a ^ b).bit_count() <= 2])
    first = {}
    for doc_id in sorted(prints):
        first.setdefault(root[prints[doc_id]], doc_id)
    assert sorted(r.doc_id for r in single) == sorted(first.values())

    kept = brute(sorted((r.doc_id, r.text) for r in single), 20)
    before = {r.doc_id: r.text for r in single}
    for r in unrepeated:
        same = len(kept[r.doc_id]) == len(WORD.findall(before[r.doc_id] or ""))
        assert r.text == (before[r.doc_id] if same else " ".join(kept[r.doc_id])) and r.n_chars == len(r.text)

    items = [" ".join(tokens_of(r.text)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaking = {r.doc_id for r in unrepeated if any(i in " ".join(tokens_of(r.text)) for i in items)}
    assert leaking == {r.doc_id for r in unrepeated} - {r.doc_id for r in clean}

    ids = tokenizer()
    check_pieces(pieces, {r.doc_id: [*ids.encode(r.text, add_special_tokens=False).ids, 1] for r in clean}, 2048)
    assert vocabulary(BYTE_BPE)


def test_registered():
    assert set(registry.ORACLE) <= set(registry.QUERIES)
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op")} == set(range(1, 14))
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" in registry.QUERIES
