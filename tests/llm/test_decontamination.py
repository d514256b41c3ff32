import random

from galley.llm.decontamination import Benchmark, clean_documents, contaminations, greedy_tiles, tokens_of
from tests.llm.helpers import no_documents, odd_documents

ITEMS = "item_id long, text string, doc_id string, coverage int"


def words(prefix, n):
    return [f"{prefix}{k}" for k in range(n)]


def cases(spark):
    item = words("q", 30)
    front, middle, back = item[:10], item[10:20], item[20:]
    noise = words("n", 200)
    documents = {
        100: item, 101: noise[:50] + item + noise[50:], 102: back + noise[:5] + front + noise[5:9] + middle,
        103: [w.upper() + "," for w in item], 104: front, 105: noise, 106: [w for pair in zip(item, noise) for w in pair],
        107: item[:18] + noise, 108: item[:17] + noise, 109: item + item, 110: item[::-1], 111: ["short", "one"], 112: ["short", "x", "one"],
    }
    frame, _ = odd_documents(spark, [(d, " ".join(t)) for d, t in documents.items()])
    items = [(1, " ".join(item)), (2, None), (3, " ... "), (4, "short, one"), (1, " ".join(item)), (9, " ".join(words("other", 40)))]
    return frame, spark.createDataFrame([(*i, "d", 1) for i in items], ITEMS)


def test_cases(spark):
    frame, benchmark = cases(spark)
    rows = contaminations(frame, benchmark).collect()
    expected = {(d, 1): 30 for d in (100, 101, 102, 103, 109)} | {(107, 1): 18, (111, 4): 2}
    assert {(r.doc_id, r.item_id): r.matched_tokens for r in rows} == expected
    assert len(rows) == 2 * 6 + 1  # item 1 is there twice
    tiles = {r.doc_id: r.tiles for r in rows}
    assert tiles[102] == 3 and tiles[100] == tiles[109] == 1
    kept = clean_documents(frame, benchmark)
    assert kept.columns == frame.columns
    assert kept.count() == frame.count() - 7


def test_benchmark_in_parts_gives_the_same(spark):
    frame, benchmark = cases(spark)
    whole = sorted(map(str, contaminations(frame, benchmark).collect()))
    assert sorted(map(str, contaminations(frame, benchmark, part_bytes=100).collect())) == whole


def test_empty_sides(spark):
    frame, benchmark = cases(spark)
    assert contaminations(no_documents(spark), benchmark).count() == 0
    assert contaminations(frame, benchmark.limit(0)).count() == 0
    assert clean_documents(frame, benchmark.limit(0)).count() == frame.count()


def plain_tiles(doc, item, seed):
    """Greedy string tiling by definition."""
    free_d, free_i, tiles = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and free_d[i + n] and free_i[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < seed:
            return tiles
        tiles.append(n)
        free_d[i : i + n] = [False] * n
        free_i[j : j + n] = [False] * n


def test_tiles_equal_the_definition():
    draw = random.Random(8)
    for _ in range(150):
        letters = "abcd"[: draw.randint(1, 4)]
        doc, item = ([draw.choice(letters) for _ in range(draw.randint(3, 40))] for _ in range(2))
        known = Benchmark([(1, " ".join(item))], 3)
        [found] = known.contaminations(" ".join(doc), 0.0) or [None]
        expected = plain_tiles(doc, item, 3)
        assert (found.matched, found.count, found.longest) == (sum(expected), len(expected), expected[0]) if expected else found is None
    import numpy as np

    none = np.empty(0, dtype=np.int64)
    assert greedy_tiles(none, none, none, 3, 5, 5) == []
    assert tokens_of("It's A-Test_1!") == ["it", "s", "a", "test_1"]


def test_planted_passages_of_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    documents, benchmark = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: " ".join(tokens_of(r.text)) for r in benchmark.collect()}
    expected = {(r.doc_id, i) for r in documents.collect() for i, t in items.items() if t in " ".join(tokens_of(r.text))}
    assert expected <= {(r.doc_id, r.item_id) for r in contaminations(documents, benchmark).collect()}


def test_a_repeating_text_takes_little_memory():
    import tracemalloc

    known = Benchmark([(1, "the " * 500), (2, " ".join(words("q", 40)))], 5)
    text = "the " * 20_000 + " ".join(words("q", 40))
    tracemalloc.start()
    found = known.contaminations(text, 0.6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(t.item, t.matched, t.count) for t in found} == {(1, 500, 1), (2, 40, 1)}
    assert peak < 300e6


def test_matches_do_not_depend_on_the_stretch(monkeypatch):
    from galley.llm import decontamination

    draw = random.Random(4)
    for _ in range(30):
        item, doc = draw.choices("abc", k=40), draw.choices("abc", k=120)
        known = Benchmark([(1, " ".join(item)), (2, " ".join(item[:9]))], 3)
        monkeypatch.setattr(decontamination, "PAIRS", 1 << 20)
        whole = known.contaminations(" ".join(doc), 0.1)
        monkeypatch.setattr(decontamination, "PAIRS", draw.choice([1, 7, 50]))
        assert known.contaminations(" ".join(doc), 0.1) == whole
