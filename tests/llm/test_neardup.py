"""Near duplicates against brute force: recall near the threshold, large buckets, hubs, boilerplate, keys that repeat or miss."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_operators import DOC, EDGE, SF, WORD
from tidegate.llm import neardup


def hashed(words):
    return np.array([hash(x) for x in words], np.int64).view(np.uint64)


def united(keys, links):
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {k: root(k) for k in keys}


def found(spark, rows):
    return {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_banded_distance():
    rng = random.Random(1)
    for _ in range(800):
        a = [rng.randint(0, 5) for _ in range(rng.randint(0, 70))]
        b = [x for x in a if rng.random() > 0.1]
        for _ in range(rng.randint(0, 5)):
            b.insert(rng.randint(0, len(b)), rng.randint(0, 5))
        band = rng.randint(0, 20)
        assert neardup.banded_distance(np.array(a, np.uint64), np.array(b, np.uint64), band) == min(neardup.plain_distance(a, b), band + 1)
        assert neardup.common_words(np.array(a, np.uint64), np.array(b, np.uint64)) == sum((collections.Counter(a) & collections.Counter(b)).values())


def test_alignment_of_a_very_long_text():
    rng = np.random.default_rng(3)
    a = np.concatenate((rng.integers(0, 2**60, 30000), rng.integers(0, 3, 3000))).astype(np.uint64)
    b = np.delete(a, rng.integers(0, len(a), 40))
    b[::700] = 7
    assert 0 < neardup.banded_distance(a, b, 400) <= 40 + len(b[::700])


def test_sketches_take_the_least_in_order():
    rng = np.random.default_rng(4)
    sizes = [0, 1, 2, 3, 40, 500]
    hashes, at = rng.integers(0, 2**63, sum(sizes)).astype(np.uint64), np.concatenate(([0], np.cumsum(sizes)))
    got = neardup.order_sketches(hashes, at, 8, 3)
    for s in range(8):
        for i, n in enumerate(sizes):
            x = neardup.permuted(hashes[at[i] : at[i + 1]], 1000 + s)
            least = np.sort(np.argsort(x)[:3])
            key = np.uint64(s + 1)
            for v in [*x[least].tolist(), *[0xFFFFFFFFFFFFFFFF] * (3 - min(3, n))]:
                key = neardup.ta.mix(np.array([key]) * np.uint64(neardup.ta.BASE) + np.array([v], np.uint64))[0]
            assert not n and not got[i, s] or got[i, s] == key


def test_near_duplicates(spark, docs, texts, edge, none):
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    words = {d: WORD.findall(t.lower()) for d, t in texts.items()}
    ids = [d for d in sorted(words) if words[d]]
    rows = {d: hashed(words[d]) for d in ids}
    links = [(a, b) for i, b in enumerate(ids) for a in ids[:i] if neardup.similarity(rows[a], rows[b]) > 0]
    assert got == united(sorted(words), links)
    seen = collections.defaultdict(list)
    for r in neardup.near_duplicates(edge).collect():
        seen[r["class_id"]].append(r["doc_id"])
    assert sorted(seen[5]) == [5, 6, 6] and seen[1] == [1] and seen[2] == [2] and seen[3] == [3] and sum(map(len, seen.values())) == len(EDGE)
    assert neardup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("changed, common", [(24, 0), (24, 92)])
def test_recall_near_the_threshold(spark, changed, common):
    """Pairs of 120 words, of which some are changed, with a passage that all texts share: buckets of hundreds of unlike texts."""
    rng = random.Random(changed + common)
    rows, footer = [], [f"f{i}" for i in range(common)]
    for i in range(400):
        own = [f"w{rng.randint(0, 10**7)}" for _ in range(120)]
        other = list(own)
        for at in rng.sample(range(120), changed):
            other[at] = f"v{rng.randint(0, 10**7)}"
        rows += [(2 * i, " ".join(own + footer)), (2 * i + 1, " ".join(other + footer))]
    got = found(spark, rows)
    together = sum(got[2 * i] == got[2 * i + 1] for i in range(400))
    assert together >= 0.9 * 400 and len(set(got.values())) == 800 - together


def test_every_bucket_is_settled(spark):
    """All pairs that share a bucket, however large, are in one class if they are similar; no other texts are."""
    rng = random.Random(7)
    rows = []
    for i in range(220):
        shared = [f"s{j}" for j in range(70)]
        own = [f"g{i % 60}x{j}" for j in range(40)]
        for _ in range(rng.randint(0, 16)):
            own[rng.randint(0, 39)] = f"v{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(shared + own)))
    got = found(spark, rows)
    words = {k: hashed(t.split()) for k, t in rows}
    alike = [(a, b) for a in words for b in range(a + 1, len(words)) if neardup.similarity(words[a], words[b]) > 0]
    whole = united(words, alike)
    assert len(alike) > 200 and got == whole  # the common passage puts nearly all into shared buckets, so all links are found


@pytest.mark.parametrize("most", [0, 3, 1000])
def test_key_pieces_meet_every_similar_text(most):
    rng = random.Random(9 + most)
    common = np.random.default_rng(most).integers(0, most + 1, 2 * neardup.SLOTS)
    for _ in range(300):
        a = [rng.randint(0, 60) for _ in range(rng.randint(1, 60))]
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = [rng.randint(0, 60)] * rng.randint(0, 1)
        a, b = (np.array(v, np.uint64) for v in sorted((a, b), key=len, reverse=True))
        if not len(b) or neardup.similarity(a, b) == 0 or len(a) == 1:
            continue
        code, place, meet = neardup.key_pieces(a, common)
        off = int(0.2 * len(a) + 1e-9)
        all_code, all_place, _ = neardup.all_pieces(b)
        assert sum(any(c == d and abs(p - q) <= off for d, q in zip(all_code, all_place)) for c, p in zip(code, place)) >= meet


def test_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randint(0, 119)] = f"v{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(120))) for i in range(50)]
    got = collections.Counter(found(spark, rows).values())
    assert got[0] == 300 and len(got) == 51
    texts = neardup.materialise(neardup.sketch_texts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", neardup.SKETCHES, neardup.ORDERED).withColumnRenamed("key", "id"), "test")
    shared = neardup.shared_buckets(texts)
    assert neardup.candidate_pairs(shared, neardup.large_members(shared, texts)).count() < 300 * 75  # not the 44,850 pairs of the group


def test_hub_of_unlike_copies(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    rows = [(5000, " ".join(base))]
    for i in range(1200):
        w = list(base)
        for at in rng.sample(range(20), 3):  # three blocks of 5%: 0.85 like the base, about 0.7 like each other
            w[at * 10 : at * 10 + 10] = [f"v{rng.randint(0, 10**8)}" for _ in range(10)]
        rows.append((i, " ".join(w)))
    assert set(found(spark, rows).values()) == {0}


def test_moved_passages_are_no_near_duplicates(spark):
    """The alignment decides: a text whose halves changed places has nearly all its shingles, but not its order."""
    words = [f"w{i}" for i in range(200)]
    assert found(spark, [(1, " ".join(words)), (2, " ".join(words[100:] + words[:100]))]) == {1: 1, 2: 2}


def test_keys_that_repeat_or_miss(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    docs = spark.createDataFrame([(1, a, 1), (1, b, 2), (2, a + " x", 3), (None, a, 4), (None, b + " y", 5), (None, "c d e", 6), (None, "c d e", 7), (None, None, 8), (3, b, 9), (3, b, 10)], "doc_id long, text string, class long")
    got = collections.Counter((r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(docs).collect())
    assert got == {(1, 1): 2, (2, 1): 1, (None, 1): 2, (None, None): 3, (3, 1): 2}
    kept = neardup.without_duplicates(docs)
    assert kept.columns == docs.columns
    kept = [r["class"] for r in kept.collect()]
    assert {1, 2, 8} < set(kept) and len(kept) == 4 and len({6, 7} & set(kept)) == 1


def test_one_row_stays_of_each_class(spark):
    docs = spark.createDataFrame(EDGE, DOC)
    assert sorted((r["doc_id"] or 0) for r in neardup.without_duplicates(docs).collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10]
    assert neardup.without_duplicates(docs.limit(0)).count() == 0
    many = spark.createDataFrame([(7, "the same text in all rows of the table")] * 500, "doc_id long, text string")
    assert neardup.without_duplicates(many).count() == 1


def test_classes(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (200, 150)], "a long, b long")
    got = {r["id"]: r["class"] for r in neardup.classes(links).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[150] == got[200] == 100
    # A node of thousands of links is joined apart.
    star = spark.range(1, 3001).selectExpr("5000L AS a", "id AS b").union(spark.createDataFrame([(3000, 7001), (7001, 7002)], "a long, b long"))
    got = {r["id"]: r["class"] for r in neardup.classes(star).collect()}
    assert set(got.values()) == {1} and len(got) == 3002


def test_bags_leave_no_similar_pair_out(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    texts = [base]
    for n in (3, 12, 23, 24, 25, 40, 90):
        for _ in range(6):
            t = base[:]
            for _ in range(n):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 2)] = [rng.choice(words)] * rng.randint(0, 2)
            texts.append(t)
    texts += [["same"] * 600, ["same"] * 560, ["same"] * 400, []]
    rows = neardup.word_rows(pa.array([" ".join(t) for t in texts]))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string")
    pairs = [(i, j) for j in range(len(texts)) for i in range(j)]
    similar = {(i, j) for i, j in pairs if neardup.similarity(rows[i], rows[j]) > 0}
    for most in (neardup.MOST_WORDS, 0):
        monkeypatch.setattr(neardup, "MOST_WORDS", most)
        got = {(r["a"], r["b"]) for r in neardup.near_bags(spark.createDataFrame(pairs, "a long, b long"), df).collect()}
        assert similar <= got and (len(got) < 0.9 * len(pairs) if most else len(got) == len(pairs))


def test_pieces_in_reach(spark):
    """No similar pair is left out, and a piece that is moved farther than its number among the pieces allows does not meet."""
    rng = random.Random(12)
    rows, ok = [], []
    for i in range(300):
        a = [rng.randint(0, 40) for _ in range(rng.randint(2, 60))]
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = [rng.randint(0, 40)] * rng.randint(0, 1)
        a, b = (np.array(v, np.uint64) for v in sorted((a, b), key=len, reverse=True))
        if len(b) and neardup.similarity(a, b) > 0:
            *keys, meet = neardup.key_pieces(a, rng.choice((np.zeros(2 * neardup.SLOTS, np.int64), np.random.default_rng(i).integers(0, 9, 2 * neardup.SLOTS))))
            ok.append(i)
            for which, found, words in (("x", neardup.ranges(*keys), len(a)), ("y", neardup.ranges(*neardup.all_pieces(b)[:2]), len(b))):
                rows += [(which, i, words, meet, int(r[0].view(np.int64)), *map(int, r[1:])) for r in zip(*found, strict=True)]
    assert len(ok) > 100
    df = spark.createDataFrame(rows, "which string, id long, words int, meet int, code long, first int, last int, times int, first_number int, last_number int")
    x, y = df.where("which = 'x'").alias("x"), df.where("which = 'y'").alias("y")
    met = x.join(y, (neardup.F.col("x.id") == neardup.F.col("y.id")) & (neardup.F.col("x.code") == neardup.F.col("y.code")) & neardup.in_reach("x", "y", 0.8))
    got = {r["id"] for r in met.groupBy("x.id").agg(neardup.F.sum("x.times").alias("n"), neardup.F.first("x.meet").alias("meet")).where("n >= meet").collect()}
    assert got == set(ok)
    # One hundred words, so 20 edits: the second of 22 pieces may be moved by one place, not by five.
    schema = "words int, meet int, first int, last int, first_number int, last_number int"
    one = spark.createDataFrame([(100, 2, 8, 8, 2, 2)], schema).alias("x").crossJoin(spark.createDataFrame([(100, 2, q, q, 1, 1) for q in (3, 7, 8, 9, 13)], schema).alias("y"))
    assert {r["first"] for r in one.where(neardup.in_reach("x", "y", 0.8)).select("y.first").collect()} == {7, 8, 9}


@pytest.mark.parametrize("bits", [64, 1 << 23])
def test_only_rows_that_may_be_wanted_move(spark, monkeypatch, bits):
    monkeypatch.setattr(neardup, "MARK_BITS", bits)
    rows = spark.range(2000).selectExpr("id", "xxhash64(id) AS mark")
    got = neardup.by_mark(rows, "mark", rows.where("id % 100 = 0").select("mark"))
    may = {r["id"] for r in got.where("_may").collect()}
    assert got.count() == 2000 and set(range(0, 2000, 100)) <= may and len(may) < (30 if bits > 64 else 1000)
    assert not neardup.by_mark(rows, "mark", rows.limit(0).select("mark")).where("_may").count()
    if bits == 64:
        test_keys_that_repeat_or_miss(spark)


def test_texts_that_share_a_heavy_piece_meet_with_their_bags(spark, monkeypatch):
    """A pair of words that many texts repeat brings together only those that may be similar, and all of these."""
    monkeypatch.setattr(neardup, "HEAVY_MEETINGS", 500, raising=False)
    monkeypatch.setattr(neardup, "KEYS_A_COPY", 16, raising=False)
    monkeypatch.setattr(neardup, "texts_of", lambda ids, texts, *_: texts)
    monkeypatch.setattr(neardup, "near_bags", lambda pairs, *_: pairs)
    rng = random.Random(13)
    words = [f"w{i}" for i in range(400)]
    texts = [rng.sample(words, 40) + ["a", "b"] * 60 for _ in range(60)]
    for t in texts[:12]:
        other = t[:]
        for at in rng.sample(range(40), 20):
            other[at] = rng.choice(words)
        texts.append(other)
    texts += [rng.sample(words, 400) for _ in range(200)]  # so that single words are dearer than the pair
    df = spark.createDataFrame([(i, i, " ".join(t)) for i, t in enumerate(texts)], "id long, class long, text string")
    got = {(r["a"], r["b"]) for r in neardup.segment_pairs(df.select("id", "class"), df.select("id", "text"), df, "id", "text").collect()}
    rows = neardup.word_rows(pa.array([" ".join(t) for t in texts]))
    similar = {(i, j) for j in range(len(texts)) for i in range(j) if neardup.similarity(rows[i], rows[j]) > 0}
    assert len(similar) >= 12 and similar <= got and len(got) < 100  # 2,556 pairs repeat the two words


def test_numbered_words_never_count_too_little():
    rng = random.Random(14)
    for _ in range(200):
        x, y = (np.array([rng.randint(0, 9) << 32 for _ in range(rng.randint(1, 40))], np.uint64) for _ in range(2))
        a, b = neardup.numbered_words(x), neardup.numbered_words(y)
        assert len(np.intersect1d(a, b)) + len(x) - len(a) >= neardup.common_words(x, y)
