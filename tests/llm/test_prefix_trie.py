import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from galley.llm.prefix_trie import conversation_trie
from galley.llm.registry import op13_prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
ROWS = "conv_id long, turn long, role string, text string, ids string, words int, shard double"


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [t for *_, t in sorted(turns, key=lambda t: t[:2])] for c, turns in own.items()}
    built = {}
    for conv, turns in own.items():
        head = zlib.crc32(str(conv).encode()) % 4
        built[conv] = own.get(conv - conv % 20, [])[:head] + turns[head:]
    return built


def plain_trie(rows):
    built = rebuilt(rows)
    members, children = defaultdict(list), defaultdict(int)
    for conv, turns in built.items():
        for depth in range(len(turns) + 1):
            members[tuple(turns[:depth])].append(conv)
    for node in members:
        if node:
            children[node[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        words = (len(convs) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        for depth in range(len(node) + 1):
            saved[node[:depth]] += words
            leaves[node[:depth]] += not children[node]
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), children[node], leaves[node], saved[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select(COLUMNS).collect()), key=repr)


def frame_of(spark, rows):
    return spark.createDataFrame([(*row, "x", 1, 0.5) for row in rows], ROWS)


def test_all_conversations(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(op13_prefix_trie(spark, sf_dir)) == plain_trie(rows)


def small_world(seed, convs, turns, texts):
    draw = random.Random(seed)
    rows = []
    for conv in draw.sample(range(3 * convs), convs):
        for turn in range(draw.randint(1, turns)):
            rows.append((conv, turn, draw.choice(["user", None]), draw.choice(texts)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, convs, turns, texts", [(1, 120, 4, ["a b", "c", None, ""]), (2, 60, 40, ["x y z"]), (3, 90, 3, ["one"])])
def test_many_shards(spark, seed, convs, turns, texts):
    """Few different turns: deep shared paths and long lists of ends cross the borders of shards."""
    rows = small_world(seed, convs, turns, texts)
    frame, expected = frame_of(spark, rows), plain_trie(rows)
    for shard_rows in (2, 7, 1_000):
        assert rows_of(conversation_trie(frame, shard_rows=shard_rows)) == expected


def test_one_conversation_that_most_repeat(spark, monkeypatch):
    from galley.llm import prefix_trie

    monkeypatch.setattr(prefix_trie, "CHUNK_BYTES", 60)
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(5)]
    rows += [(c, t, "user", f"turn {t}") for c in range(300, 310) for t in range(7)]
    rows += [(1_000, t, "user", f"turn {t} of a long one") for t in range(400)]
    assert rows_of(conversation_trie(frame_of(spark, rows), shard_rows=25)) == plain_trie(rows)


def test_odd_rows(spark):
    rows = [
        (0, 0, "user", "hello you"), (0, None, None, None), (0, 1, "user", " \n"), (1, 0, "user", "hello you"), (1, -3, "", ""),
        (2, 5, "user", "word " * 50_000), (3, 5, "user", "word " * 50_000), (20, 0, "a", "b:c"), (21, 0, "a:", "bc"),
        (22, 0, "a", ":bc"), (-7, 0, "user", "below zero"), (-20, 0, "user", "first"), (-20, 1, "user", "second"),
        (-20, 2, "user", "third"), (41, 0, "user", "only one"), (47, 0, "user", "only one"), (48, 0, "user", "only one"),
    ]
    expected = plain_trie(rows)
    assert rows_of(conversation_trie(frame_of(spark, [*rows, (None, 0, "user", "no id"), (None, None, None, None)]))) == expected
    assert any(turns == [] for turns in rebuilt(rows).values())
    tied = [(5, 0, "user", "b"), (5, 0, "user", "a"), (5, 0, "user", "a")]
    one = rows_of(conversation_trie(frame_of(spark, tied)))
    assert [row[1] for row in one] == list(range(len(one))) and one == rows_of(conversation_trie(frame_of(spark, tied[::-1])))
    assert conversation_trie(frame_of(spark, [])).count() == 0
    assert conversation_trie(frame_of(spark, [(None, 0, "user", "no id")])).count() == 0


def test_only_conversations_without_turns(spark):
    empty = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0][:3]
    rows = [(c, 0, "user", "gone") for c in empty]
    assert rows_of(conversation_trie(frame_of(spark, rows), shard_rows=1)) == plain_trie(rows)
