"""Template decontamination against a plain Python version that compares every document with every item."""

import collections
import math
import random

import regex

from tests.llm.test_operators import EDGE, SF
from tidegate.llm import decontaminate as D

O, C = "\ue000", "\ue001"


def tokens(text):
    t = regex.sub(f"[{O}{C}]", " ", text or "")
    t = regex.sub(D.NUMBER, lambda m: f"{O}n{m[0]}{C}", t)
    units = "|".join(sorted(map(regex.escape, D.UNITS.split()), key=len, reverse=True))
    t = regex.sub(rf"(?<={C})\x20?({units})(?![\p{{L}}\p{{N}}])", lambda m: f" {O}u{m[1]}{C}", t)
    t = regex.sub(D.NAME, lambda m: f"{O}a{m[0]}{C}", t)
    t = regex.sub(D.OPENER, lambda m: f"{O}o{m[0]}{C}", t)
    return regex.findall(D.TOKEN, t.lower())


def code(t, reading):
    if t.startswith(O + "o"):
        return O + "a" if reading == "named" else t[2:-1]
    if t.startswith(O + "a") and reading == "literal":
        return t[2:-1]
    return t[:2] if t.startswith(O) else t


def windows(found, reading, n=5):
    c = [code(t, reading) for t in found]
    return [tuple(c[i : i + n]) for i in range(len(c) - n + 1)]


def leak(own, item):
    """share, slots, changed and kind, or None."""
    slot = lambda t: t.startswith(O) and not t.startswith(O + "o")
    wanted = {(i, w) for r in ("plain", "named") for i, w in enumerate(windows(item, r)) if sum(not slot(t) for t in item[i : i + 5]) >= 3}
    readings, whole = ("plain", "named", "literal"), not wanted
    if whole:
        wanted, readings = {(0, ("all", *(code(t, "plain") for t in item)))} if item else set(), ()
        held = [(p, ("all", *w)) for p, w in enumerate(windows(own, "plain", len(item)))] if item else []
    else:
        held = [x for r in readings for x in enumerate(windows(own, r))]
    by = collections.defaultdict(set)
    for i, w in wanted:
        by[w].add(i)
    common = {(p, i) for p, w in held for i in by.get(w, ())}
    total = len({i for i, _ in wanted})
    share = len({i for _, i in common}) / total if total else 0
    if not common or share < 0.8 - 1e-9:
        return None
    shifts = collections.Counter(p - i for p, i in common)
    shift = min(shifts, key=lambda k: (-shifts[k], k))
    kind = lambda t: O + "a" if t.startswith(O + "o") else t[:2]
    pairs = collections.Counter()
    for i, v in enumerate(item):
        if v.startswith(O) and 0 <= i + shift < len(own) and own[i + shift].startswith(O) and kind(own[i + shift]) == kind(v):
            pairs[kind(v), v[2:-1], own[i + shift][2:-1]] += 1
    best = lambda key, rest: min((p for p in pairs if p[0] == key[0] and p[rest[0]] == key[rest[0]]), key=lambda p: (-pairs[p], p[rest[1]]))
    agreeing = sum(n for p, n in pairs.items() if best(p, (1, 2)) == p and best(p, (2, 1)) == p)
    slots, changed = sum(pairs.values()), sum(n for p, n in pairs.items() if p[1] != p[2])
    if agreeing < slots * 0.8 - 1e-9 or whole and changed:
        return None
    return round(share, 9), slots, changed, "reparameterised" if changed else "exact"


def expected(rows, items):
    told = {(k, i): leak(own, item) for k, t in rows if (own := tokens(t)) for i, u in items if (item := tokens(u))}
    return {k: v for k, v in told.items() if v}


def found(spark, rows, items):
    a, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): (round(r["share"], 9), r["slots"], r["changed"], r["kind"]) for r in D.find_leaks(a, b).collect()}


ITEMS = [
    (1, "yesterday Tom had 5 apples and gave 3 apples to Anna but then Tom lost 5 kg of them"), (2, "tiny item"), (3, None), (4, "Short question with eight words in it here"),
    (5, "Tom walked to the market with a large basket. Anna stayed in the small house and read a book. Tom came back late in the evening"),
    (6, "the first train leaves with 40 people and the second with 25 people and the last with 3 people on board"), (7, "7 kg 8 kg 9 kg"), (8, ""),
]
ROWS = [
    (1, "intro words here. yesterday Mark had 8 apples and gave 2 apples to Julia but then Mark lost 8 kg of them. more"), (2, "yesterday Tom had 5 apples and gave 3 apples to Anna but then Tom lost 5 kg of them"),
    (3, "yesterday Mark had 8 apples and gave 2 apples to Julia but then Peter lost 9 kg of them"), (4, "yesterday we had apples"), (5, None), (6, "and before that, Short question with eight words in it here and more"),
    (7, "Well. Jane walked to the market with a large basket. Paul stayed in the small house and read a book. Jane came back late in the evening."),
    (8, "the first train leaves with 9 people and the second with 9 people and the last with 9 people on board"), (9, "the first train leaves with 9 people and the second with 8 people and the last with 7 people on board"),
    (10, "a tiny item indeed"), (11, "only 7 kg 8 kg 9 kg"), (12, "only 7 kg 8 kg 1 kg"), (13, "tiny Item"),
]


def test_planted_cases(spark):
    got = found(spark, ROWS, ITEMS)
    assert got == expected(ROWS, ITEMS)
    assert {k: v[3] for k, v in got.items()} == {(1, 1): "reparameterised", (2, 1): "exact", (6, 4): "exact", (7, 5): "reparameterised", (9, 6): "reparameterised", (10, 2): "exact", (11, 7): "exact"}


def test_random_cases(spark):
    """Small vocabularies, so that windows are common to many items and documents."""
    rng = random.Random(11)
    word = lambda: rng.choice(["the", "of", "cat", "Tom", "Anna", "red", "7", "12", "kg", "runs", "far."])
    items = [(i, " ".join(word() for _ in range(rng.randint(0, 12)))) for i in range(25)]
    rows = []
    for i in range(120):
        parts = [items[rng.randrange(25)][1].split() for _ in range(rng.randint(1, 2))]
        t = [w if rng.random() < 0.95 else word() for p in parts for w in p] + [word() for _ in range(rng.randint(0, 5))]
        rows.append((i, " ".join(t)))
    want = expected(rows, items)
    assert len(want) > 60 and found(spark, rows, items) == want


def test_given_tables(spark, docs, texts):
    bench = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]): (round(r["share"], 9), r["slots"], r["changed"], r["kind"]) for r in D.find_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    sure = [(d, i) for d, t in texts.items() for i, u in bench.items() if u in t]
    assert sure and set(sure) <= set(got)
    owns, items = {d: tokens(texts[d]) for d in {d for d, _ in got} | set(list(texts)[:40])}, {i: tokens(u) for i, u in bench.items()}
    assert {k: v for k, v in got.items() if k[0] in owns} == {(d, i): v for d, own in owns.items() for i, item in items.items() if (v := leak(own, item))}


def test_rows_are_documents(spark, edge):
    """Two halves under one key are no leak; rows without a key are found; only rows that leak go."""
    item = ITEMS[0][1]
    words = item.split()
    half = len(words) // 2
    rows = [(1, " ".join(words[:half])), (1, " ".join(words[half:])), (None, "so " + item), (None, "clean words"), (2, item), (2, "clean words"), (3, item), (3, item)]
    a, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = collections.Counter(r["doc_id"] for r in D.find_leaks(a, b).collect())
    assert got == {None: 1, 2: 1, 3: 1}
    kept = D.without_leaks(a.withColumn("mark", D.F.lit(1)), b)
    assert kept.columns == ["doc_id", "text", "mark"] and sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([rows[0], rows[1], (None, "clean words"), (2, "clean words")], key=str)
    assert D.find_leaks(edge, b).count() == 0 and D.without_leaks(edge, b).count() == len(EDGE)
    assert D.find_leaks(a, b.limit(0)).count() == 0 and D.find_leaks(a.limit(0), b).count() == 0


def test_key_windows_are_few_and_enough(spark):
    items = spark.createDataFrame([(i, "all items share this long opening of words and then come " + " ".join(w + chr(97 + i // 6) + chr(97 + i % 6) for w in "some words of its own kind here".split())) for i in range(30)], "item_id long, text string")
    windows = D.item_windows(items, "item_id", "text")
    keys = D.key_windows(windows, 0.8).join(windows, ["item", "code"])
    total = windows.groupBy("item").agg(D.F.count_distinct("at").alias("n")).collect()
    got = {r["item"]: r["n"] for r in keys.groupBy("item").agg(D.F.count_distinct("at").alias("n")).collect()}
    assert all(got[r["item"]] == r["n"] - math.ceil(r["n"] * 0.8 - 1e-9) + 1 for r in total)
    assert keys.groupBy("code").agg(D.F.count_distinct("item").alias("n")).agg(D.F.max("n")).first()[0] == 1
