"""Conversation prefix trie against a plain trie."""
import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from nearmiss.llm.queries import op12_prefix_trie
from nearmiss.llm.trie import WIDTH, number_turns, prefix_trie, regraft

SCHEMA = "conv_id long, turn long, role string, text string, depth string, a string, block string"


def brute(rows):
    chats = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            chats[conv].append((turn is not None, turn or 0, role or "", text or ""))
    chats = {c: [x[2:] for x in sorted(t)] for c, t in chats.items()}
    built = {}
    for c, own in chats.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c % 5 if c >= 0 else -(-c % 5))
        built[c] = tuple(chats.get(base, [])[:h] + own[h:])
    members, out = defaultdict(list), []
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(set)
    for node in members:
        if node:
            kids[node[:-1]].add(node)
    saved, leaves = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(who) - 1) * (len(node[-1][1].encode()) if node else 0)
            leaves[node[:d]] += not kids[node]
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(built[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def run(df):
    convs, turns = regraft(number_turns(df))
    cols = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted((tuple(r) for r in prefix_trie(convs, turns).select(*cols).collect()), key=lambda r: r[:2])


def odd_rows():
    rng, rows = random.Random(1), []
    x = ("x", "y", "z")
    for c in range(-6, 40):
        for t in range(rng.randrange(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "é", None, "", "long text"]), *x))
    long = [(t, "user" if t % 2 else "assistant", f"turn {t % 7}") for t in range(3 * WIDTH + 3)]
    for c in (100, 103, 104, 110, 115, 120):
        rows += [(c, t, r, s + ("!" if c == 120 and t == 2 * WIDTH else ""), *x) for t, r, s in long[:len(long) - (c == 115)]]
    rows += [(7, None, None, None, *x), (7, None, "user", "first", *x), (8, 1, "user", "tie", *x), (8, 1, "user", "tie", *x), (8, 1, "assistant", "tie", *x), (None, 1, "user", "none", *x)]
    rows += [(200 + i, 0, "user", "hello", *x) for i in range(30)]
    return rows


def test_as_a_plain_trie(spark):
    rows = odd_rows()
    got = run(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows)
    assert max(r[1] for r in got) > 2 * WIDTH and sum(r[3] > 1 for r in got) > 20


def test_packed_ends(spark, monkeypatch):
    from nearmiss.llm import trie
    monkeypatch.setattr(trie, "_PACKED", 6)
    rows = odd_rows()
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = op12_prefix_trie(spark, sf)
    assert sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2]) == brute(rows)


@pytest.mark.parametrize("text", ["x" * 300_000])
def test_very_long_text(spark, text):
    rows = [(1, 0, "user", text, "", "", ""), (2, 0, "user", text, "", "", "")]
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
