"""The prefix trie against a plain one, and list ranking against walking."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from tidegate.llm import listrank, trie

TURN = "conv_id long, turn long, role string, text string"


def plain_trie(rows, shared_by=100, most=6):
    own = collections.defaultdict(list)
    for c, *rest in rows:
        if c is not None:
            own[c].append(rest)
    for c in own:
        own[c] = [(r or "", t or "") for n, r, t in sorted(own[c], key=lambda x: (x[0] is not None, x[0] or 0))]
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        base = c - int(np.fmod(c, shared_by))
        rebuilt[c] = own.get(base, [])[:h] + own[c][h:]
    members = collections.defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, who in members.items():
        worth = (len(who) - 1) * len(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += kids[node] == 0
            saved[node[:d]] += worth
    out = set()
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(rebuilt[c]) == len(node)))
        out.add((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), kids[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def seen(df):
    rows = df.collect()
    assert len({(r["conv_id"], r["depth"]) for r in rows}) == len(rows)
    return {(r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}, rows


def conversations(rng, number, words="abc", longest=8):
    rows = []
    for c in {*rng.sample(range(-300, 10 * number), number), *range(-300, 10 * number, 100)}:
        for t in [None, *range(rng.randint(0, longest))][: rng.randint(1, longest)]:
            rows.append((c, t, rng.choice(["user", None, ""]), rng.choice([None, *(w * rng.randint(1, 3) for w in [*words, "", "é😀"])])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block_rows", "block_items"), [(10**6, 10**6), (37, 29)])
def test_against_plain(spark, block_rows, block_items):
    rng = random.Random(block_rows)
    rows = conversations(rng, 60) + [(100 * k + j, i, "user", f"t{i}") for k in (50, 51) for j in range(12) for i in range(k % 4 + j % 3)]
    df = spark.createDataFrame(rows, TURN)
    want = plain_trie(rows)
    got, full = seen(trie.conversation_trie(df, block_rows=block_rows, block_items=block_items))
    assert got == want
    # The places of the arcs make one tour: each once, a subtree between its node's arcs.
    places = sorted([r["enter"] for r in full] + [r["leave"] for r in full])
    assert places == list(range(2 * len(full)))
    at = {(r["conv_id"], r["depth"]): r for r in full}
    assert all(at[r["parent_conv_id"], r["depth"] - 1]["enter"] < r["enter"] < r["leave"] < at[r["parent_conv_id"], r["depth"] - 1]["leave"] for r in full if r["depth"])


def test_long_conversation_and_hot_groups(spark):
    """A conversation in many blocks, a root of many children, a node where hundreds of conversations end."""
    rows = [(5, i, "user", f"turn {i}") for i in range(400)] + [(1000 + i, 0, "user", f"only {i}") for i in range(300)] + [(3000 + i, j, "user", f"same {j}") for i in range(300) for j in range(3)]
    df = spark.createDataFrame(rows, TURN)
    for most in (1, 6):
        got, _ = seen(trie.trie(*trie.share_openings(trie.turn_rows(df, 50), most=most), block_rows=50, block_items=64))
        assert got == plain_trie(rows, most=most)


def test_edges(spark):
    assert trie.conversation_trie(spark.createDataFrame([], TURN)).count() == 0
    rows = [(None, 1, "user", "no conversation"), (7, 1, None, None), (7, 1, None, None), (7, None, "user", "first"), (8, 2, "", ""), (9, 1, "user", "x" * 100_000), (2**62, 1, "a", "b"), (-(2**62), 1, "a", "b"), (-7, 1, "a", "b")]
    df = spark.createDataFrame([(*r, "x") for r in rows], TURN + ", block string")
    assert seen(trie.conversation_trie(df))[0] == plain_trie(rows)
    # A conversation left without turns ends at the root.
    short = next(c for c in range(201, 300) if zlib.crc32(str(c).encode()) % 6 > 2)
    alone = [(short, 1, "a", "b")]
    assert seen(trie.conversation_trie(spark.createDataFrame(alone, TURN)))[0] == plain_trie(alone)


@pytest.mark.parametrize("local", [True, False])
def test_list_ranking(spark, local):
    """Lists whose names follow them, and lists without any order, which only splicing shortens."""
    rng = random.Random(4)
    names = [(i // 3, i % 3) for i in range(1500)]
    if not local:
        rng.shuffle(names)
    lists, at = [], 0
    for n in (1, 2, 700, 797):
        lists.append(names[at : at + n])
        at += n
    rows, want = [], {}
    for items in lists:
        one = two = 0
        for i, x in enumerate(items):
            w = rng.randint(0, 9)
            want[x] = (one, two)
            one, two = one + 1, two + w
            rows.append((*x, *(items[i + 1] if i + 1 < len(items) else (None, None)), 1, w))
    df = spark.createDataFrame(rows, "id long, sub long, to_id long, to_sub long, n long, w long")
    got = {(r["id"], r["sub"]): (r["n"], r["w"]) for r in listrank.rank(df, ["n", "w"], block_items=200).collect()}
    assert got == want
    assert listrank.rank(df.limit(0), ["n", "w"]).count() == 0
