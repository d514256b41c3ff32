import random

import numpy as np
import xxhash

from galley.llm.components import connected_components
from galley.llm.simhash import block_masks, close_pairs, fingerprint, fingerprint_links, keep_one_of_each, simhash_groups
from tests.llm.helpers import WORD, lower_ascii, no_documents, odd_documents


def plain_fingerprint(text, size=3):
    words = WORD.findall(lower_ascii(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(keys, linked):
    parent = {k: k for k in keys}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        low, high = sorted((top(a), top(b)))
        parent[high] = low
    return {k: top(k) for k in keys}


def test_odd_rows_and_near_copies(spark):
    draw = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(draw.choices(words, k=250)) for _ in range(6)]
    extra = []
    for k in range(60):
        edited = draw.choice(base).split()
        for _ in range(draw.randint(0, 2)):
            edited[draw.randrange(len(edited))] = draw.choice(words)
        extra.append((100 + k, " ".join(edited)))
    frame, texts = odd_documents(spark, extra)
    rows = simhash_groups(frame).collect()
    prints = {text: plain_fingerprint(text) for _, text in texts}
    of = sorted(set(prints.values()))
    root = plain_components(of, [(a, b) for i, a in enumerate(of) for b in of[i + 1 :] if (a ^ b).bit_count() <= 2])
    least = {}
    for doc_id, text in texts:
        if doc_id is not None:
            least[root[prints[text]]] = min(doc_id, least.get(root[prints[text]], doc_id))
    expected = sorted((str(d), f"{prints[t]:016x}", least.get(root[prints[t]])) for d, t in texts)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in rows) == expected
    assert len({r.component_id for r in rows}) < len({r.fingerprint for r in rows})
    kept = keep_one_of_each(frame, simhash_groups(frame)).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert sorted(ids) == sorted(least.values())
    assert simhash_groups(no_documents(spark)).count() == 0


def test_fingerprint_in_slices():
    text = " ".join(f"w{k % 7919} z{k % 13}" for k in range(20_000))
    assert fingerprint(text, 3) == plain_fingerprint(text)


def test_close_pairs_equal_brute_force():
    draw = np.random.default_rng(1)
    for radius in (0, 1, 2, 3, 5):
        centers = draw.integers(0, 1 << 63, 5, dtype=np.uint64)
        values = draw.choice(centers, 400)
        for _ in range(3):
            values = values ^ (np.uint64(1) << draw.integers(0, 64, 400, dtype=np.uint64))
        groups = np.sort(draw.integers(0, 4, 400))
        a, b = close_pairs(groups, values, radius)
        found = set(zip(a.tolist(), b.tolist(), strict=True))
        expected = {
            (i, j) for i in range(400) for j in range(i + 1, 400)
            if groups[i] == groups[j] and (int(values[i]) ^ int(values[j])).bit_count() <= radius
        }
        assert found == expected


def test_masks_lose_no_link():
    draw = random.Random(4)
    for radius in (1, 2, 3):
        masks = block_masks(radius)
        for _ in range(300):
            difference = sum(1 << b for b in draw.sample(range(64), radius))
            assert any(not difference & mask for mask in masks)


def test_dense_group_links_stay_few(spark):
    values = [(i << 8) & 0xFFFF for i in range(256)] + [0xFF << 56, (0xFF << 56) | 1]
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long").distinct()
    links = fingerprint_links(frame, 2).collect()
    masks = len(block_masks(2))
    assert len(links) <= masks * len(values)
    root = plain_components({r.fp for r in frame.collect()}, [(r.a, r.b) for r in links])
    assert len(set(root.values())) == 2


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 60)]
    star = [(100, k) for k in range(101, 140)]
    odd = [(500, 501), (501, 500), (501, 502), (7_000, 7_000), (None, 3), (502, 500)]
    found = connected_components(spark.createDataFrame(chain + star + odd, "a long, b long")).collect()
    root = {r.node: r.root for r in found}
    assert root == {**dict.fromkeys(range(2, 61), 1), **dict.fromkeys(range(101, 140), 100), 501: 500, 502: 500}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
