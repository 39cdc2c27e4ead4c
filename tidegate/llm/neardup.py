"""Near duplicates by Order MinHash, verified by banded alignment.

A text is its row of lower-case words. Its shingles (SHINGLE_WORDS words) are labelled with their occurrence number,
so that a repeated shingle counts as often as it stands. Each of SKETCHES sketches takes the ORDERED shingles of
least hash and keeps them in text order; texts that agree in a whole sketch share a bucket, which is likely if their
edit similarity is high and unlikely if only their sets of shingles are alike. A candidate pair is verified by the
edit distance of the two rows of words within a band, and linked if 1 - distance / longer length is at least
SIMILARITY. Documents joined by links form a class, named by its smallest key.

With SKETCHES sketches, a pair of similarity 0.8 whose changed words are scattered (the worst case: each breaks five
shingles) shares a bucket in 0.92 of cases (120 words), one of 0.85 in 0.99.

Scale. Equal rows of words are collapsed first by a partial aggregate, so copies never form pairs. In a bucket of up
to PAIRWISE texts all pairs are compared. A larger bucket is first thinned: its texts are divided by their next
sketch, small parts are compared pair by pair and larger ones with their first text, and then the text of most links
meets the texts of other classes. Whatever such a bucket still holds in different classes is settled exactly, without
regard to its size, by ``segment_pairs``: a join by rare pieces of text that every pair of the similarity must share.
Classes come from the links by alternating star steps, each of which is written to the shared folder; a node, text or
pair of texts with very many rows is joined apart from the others (``base.lookup``, ``attach``). Nothing is collected
to the driver but counts and a table of 2 * SLOTS numbers.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import textarrays as ta
from tidegate.llm.base import discard, lookup, materialise, release, small_batches, table

SHINGLE_WORDS, SIMILARITY = 5, 0.8
SKETCHES, ORDERED = 80, 2
#: All pairs of a bucket of up to so many texts are compared at once.
PAIRWISE = 16
#: Of a text, shingles with a hash among about so many of the least are looked at first.
LEAST_HASHES = 16
#: Counters in each of the two rows of the table that tells common pieces of text from rare ones.
SLOTS = 1 << 16
#: Key pieces that a similar text must hold; more spare comparisons and cost rows.
MEET = 2
#: A key piece of so many meetings is heavy: texts meet by it with their bags of words. There are at most HEAVY_CODES of them, a bit each.
HEAVY_MEETINGS, HEAVY_CODES = 300_000, 62
#: Texts with a heavy key piece that meet one copy of the texts that hold it.
KEYS_A_COPY = 64
#: Words of texts, as four-byte hashes, that may be broadcast to compare bags of words (16 MB), by their counted number.
MOST_WORDS = 4_000_000
#: Bits of the table by which rows are told apart before their texts move; in words of 64, so that it may be broadcast at any size.
MARK_BITS = 1 << 23
#: Pairs that meet one copy of a text in a task.
PAIRS_A_TEXT = 256


def order_sketches(hashes: np.ndarray, at: np.ndarray, sketches: int = SKETCHES, ordered: int = ORDERED, seed: int = 1) -> np.ndarray:
    """A bucket key for each text (row) and sketch (column). ``hashes``: all shingles, ``at``: where each text's begin."""
    size = np.diff(at)
    filled = np.flatnonzero(size)
    out = np.zeros((len(size), sketches), np.uint64)
    if not len(filled):
        return out
    count = size[filled]
    owner = np.repeat(np.arange(len(filled), dtype=np.uint64), count)
    labelled = occurrence_labels(hashes, owner)
    # The least hashes of a text of n shingles are almost surely below LEAST_HASHES / n of the range; where they are not, all are looked at.
    below = np.where(count > 2 * LEAST_HASHES, LEAST_HASHES / count, 1.0)
    bound = np.repeat(np.minimum(below * 2.0**64, 2.0**64 - 2048).astype(np.uint64) | np.uint64(2047), count)
    begins = np.concatenate(([0], np.cumsum(count)))
    for s in range(sketches):
        x = permuted(labelled, seed * 1000 + s)
        keep = np.flatnonzero(x <= bound)
        begin = np.searchsorted(keep, begins)
        out[filled, s] = least_in_order(x[keep], keep, begin, ordered, s)
        short = np.flatnonzero(np.diff(begin) < np.minimum(ordered, count))
        for i in short:
            lo, hi = begins[i], begins[i + 1]
            out[filled[i], s] = least_in_order(x[lo:hi], np.arange(lo, hi), np.array([0, hi - lo]), ordered, s)[0]
    return out


def permuted(labelled: np.ndarray, number: int) -> np.ndarray:
    """The hashes in another order for each number; they are mixed already, so one product will do."""
    a, b = (int(v) for v in ta.mix(np.array([2 * number + 1, 2 * number + 2], np.uint64)))
    return (labelled ^ np.uint64(a)) * np.uint64(b | 1)


def least_in_order(x: np.ndarray, place: np.ndarray, begin: np.ndarray, ordered: int, sketch: int) -> np.ndarray:
    """For each group a key of its ``ordered`` least values, taken in the order of their places."""
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    size = np.diff(begin)
    spots = np.full((len(size), ordered), np.iinfo(np.int64).max)
    values = np.full((len(size), ordered), most)
    filled = np.flatnonzero(size)
    starts, x = begin[filled], x.copy()
    for j in range(ordered):
        low = np.minimum.reduceat(x, starts)
        spot = np.flatnonzero(x == np.repeat(low, size[filled]))
        first = spot[np.searchsorted(spot, starts)]
        more = size[filled] > j
        values[filled[more], j], spots[filled[more], j] = low[more], place[first][more]
        x[first] = most
    values = np.take_along_axis(values, np.argsort(spots, 1, kind="stable"), 1)
    key = np.full(len(size), sketch + 1, np.uint64)
    for j in range(ordered):
        key = ta.mix(key * np.uint64(ta.BASE) + values[:, j])
    return key


def occurrence_labels(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Shingle hashes mixed with how many equal ones stand before them in the same text."""
    own = hashes ^ ta.mix(owner + np.uint64(1))
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    new = np.ones(len(own), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return hashes
    start = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
    number = np.empty(len(own), np.uint64)
    number[order] = (np.arange(len(own)) - start).astype(np.uint64)
    return np.where(number > 0, ta.mix(hashes + number * np.uint64(ta.MIX_B)), hashes)


def sketch_texts(docs: DataFrame, key: str, text: str, sketches: int, ordered: int) -> DataFrame:
    """For each row key, mark (a hash of the text), words, same (a hash of the row of words, null without words) and a bucket key for each sketch."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.utf8_lower(ta.column(b, "text"))
            for lo, hi in ta.chunks(texts):
                raw, off = ta.utf8(texts.slice(lo, hi - lo))
                starts, ends, at = ta.words(raw, off)
                h = ta.span_hashes(raw, starts, ends)
                grams, begin = ta.shingles(h, at, SHINGLE_WORDS)
                keys = order_sketches(grams, begin, sketches, ordered)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * sketches, pa.int32()), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(np.diff(at), pa.int32()), whole_hashes(h, at), lists], ["key", "mark", "words", "same", "buckets"])

    return docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text")).mapInArrow(run, "key long, mark long, words int, same binary, buckets array<long>")


def whole_hashes(h: np.ndarray, at: np.ndarray) -> pa.Array:
    """128 bits from the word hashes of each text; null without words."""
    count = np.diff(at)
    place = (np.arange(len(h)) - np.repeat(at[:-1], count) + 1).astype(np.uint64)
    sums = [np.concatenate(([0], np.cumsum(v))).astype(np.uint64) for v in (ta.mix(h + place * np.uint64(ta.BASE)), ta.mix((h ^ np.uint64(ta.MIX_A)) + place * np.uint64(ta.MIX_B)))]
    both = np.stack([s[at[1:]] - s[at[:-1]] for s in sums], 1)
    return pa.array([row.tobytes() if n else None for row, n in zip(both, count)], pa.binary())


def near_length(x, y, least: float):
    """Whether the lengths of two texts allow the similarity."""
    return F.abs(x - y) <= F.floor(F.greatest(x, y) * (1 - least) + 1e-9)


def all_pairs(groups: DataFrame, least: float) -> DataFrame:
    """Pairs (a < b) within each small group; ``all``: its (id, words) sorted by id."""
    found = F.flatten(F.transform("all", lambda x: F.transform(F.filter("all", lambda y: (y["id"] > x["id"]) & near_length(x["words"], y["words"], least)), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))))
    return groups.select(F.explode(found).alias("p")).select("p.a", "p.b")


def shared_buckets(texts: DataFrame) -> DataFrame:
    """bucket, sketch, id, words and n (its texts) for each text in each bucket of two texts or more; written."""
    spread = texts.select("id", "words", F.posexplode("buckets").alias("sketch", "bucket"))
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return materialise(spread.join(sizes, "bucket"), "neardup-shared")


def large_members(shared: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of buckets of more than PAIRWISE texts, with the bucket of the next sketch; written."""
    follow = F.get("buckets", (F.col("sketch") + 1) % F.size("buckets"))
    return materialise(shared.where(F.col("n") > PAIRWISE).join(texts.select("id", "buckets"), "id").select("bucket", "id", "words", follow.alias("next")), "neardup-members")


def candidate_pairs(shared: DataFrame, members: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Pairs (a < b) of texts to compare first: all of small buckets and of small parts of large ones, and the first text of a large part with the others."""
    row = F.struct("id", "words")
    small = shared.where(F.col("n") <= PAIRWISE).groupBy("bucket").agg(F.array_sort(F.collect_list(row)).alias("all"))
    parts = members.groupBy("bucket", "next").agg(F.count("*").alias("m"), F.min(row).alias("first")).where("m > 1")
    dealt = members.join(parts, ["bucket", "next"])
    tight = dealt.where(F.col("m") <= PAIRWISE).groupBy("bucket", "next").agg(F.array_sort(F.collect_list(row)).alias("all"))
    star = dealt.where((F.col("m") > PAIRWISE) & (F.col("id") > F.col("first.id")) & near_length(F.col("words"), F.col("first.words"), least)).select(F.col("first.id").alias("a"), F.col("id").alias("b"))
    return all_pairs(small.select("all").union(tight.select("all")), least).union(star).distinct()


def banded_distance(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The edit distance of two rows if it is at most ``band``, else band + 1; bit-parallel within the band.

    Memory is in proportion to the rows: a word's places are kept, and its bits are set for the window at hand.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > band:
        return band + 1
    short = len(a)
    differ = np.flatnonzero(a != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[head:][::-1] != b[len(b) - short + head :][::-1])
    tail = int(differ[0]) if len(differ) else short - head
    a, b = a[head : short - tail], b[head : len(b) - tail]
    m, n = len(a), len(b)
    if m == 0:
        return n
    if m == n and (wrong := int(np.count_nonzero(a != b))) <= 2:
        return min(band + 1, wrong)  # only the ends differ: one or two substitutions
    if m <= band or m * n <= 256:
        return min(band + 1, plain_distance(a.tolist(), b.tolist()))
    where: dict[int, list[int]] = {}
    for i, x in enumerate(a.tolist()):
        where.setdefault(x, []).append(i)
    width = 2 * band + 2
    ones, bottom = (1 << width) - 1, 1 << (width - 1)
    vp, vn, distance = ones ^ ((1 << (width - 1 - band)) - 1), 0, band
    level = bottom >> 1
    for j, x in enumerate(b.tolist()):
        match, spots = 0, where.get(x)
        if spots:
            move = j + band - (width - 1)
            if len(spots) == 1:
                at = spots[0] - move
                match = 1 << at if 0 <= at < width else 0
            else:
                match = window_bits(spots, move, width)
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & ones
        hp = (vn | ~(d0 | vp)) & ones
        hn = d0 & vp
        if j < m - band:
            distance += not d0 & bottom
        else:
            distance += bool(hp & level) - bool(hn & level)
            level >>= 1
        vp = (hn | ~((d0 >> 1) | hp)) & ones
        vn = (d0 >> 1) & hp
    return min(band + 1, distance)


def window_bits(spots: list[int], move: int, width: int) -> int:
    """Bits of the places from ``move`` on, ``width`` of them."""
    lo, hi = bisect_left(spots, move), bisect_left(spots, move + width)
    if hi - lo <= 32:
        bits = 0
        for p in spots[lo:hi]:
            bits |= 1 << (p - move)
        return bits
    flags = np.zeros(width, np.uint8)
    flags[np.array(spots[lo:hi]) - move] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def plain_distance(a: list[int], b: list[int]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """1 - distance / longer length, or 0 if that is under ``least``. Rows with too few words in common are not aligned."""
    long = max(len(a), len(b))
    band = int((1 - least) * long + 1e-9)
    if long - min(len(a), len(b)) > band or long - common_words(a, b) > band:
        return 0.0
    distance = banded_distance(a, b, band)
    return 1 - distance / max(1, long) if distance <= band else 0.0


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two rows have in common, each as often as in both."""
    if not len(a) or not len(b):
        return 0
    both = np.concatenate((a, b))
    order = np.argsort(both, kind="stable")
    ranked = both[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    own = np.add.reduceat((order < len(a)).astype(np.int64), first)
    return int(np.minimum(own, np.diff(np.append(first, len(both))) - own).sum())


def word_rows(texts: pa.Array) -> list[np.ndarray]:
    """The word hashes of each text."""
    raw, off = ta.utf8(pc.utf8_lower(pc.fill_null(texts, "")))
    starts, ends, at = ta.words(raw, off)
    h = ta.span_hashes(raw, starts, ends)
    return [h[at[i] : at[i + 1]] for i in range(len(texts))]


def by_mark(rows: DataFrame, mark: str, marks: DataFrame) -> DataFrame:
    """``rows`` with _may: whether the hash in column ``mark`` may be among ``marks`` (one column); true for all that are.

    Where there are many marks it is true for others too, so an exact join must follow; but only such rows need move.
    """
    spot = lambda m: F.pmod(m, F.lit(MARK_BITS))
    bit = lambda m: (spot(m) % 64).cast("int")
    word = lambda m: F.floor(spot(m) / 64).cast("int")
    m = F.col(marks.columns[0])
    table = marks.select(word(m).alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(m)).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    told = rows.withColumn("_word", word(F.col(mark))).join(F.broadcast(table), "_word", "left")
    return told.withColumn("_may", F.coalesce(F.getbit("_bits", bit(F.col(mark))) == 1, F.lit(False))).drop("_word", "_bits")


def texts_of(ids: DataFrame, texts: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """id and text for each of the ids."""
    told = texts.select("id", F.col("rep.key").alias("k"), F.col("rep.mark").alias("m")).join(ids, "id", "left_semi")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))
    rows = by_mark(rows, "mark", told.select("m")).where("_may").drop("_may")
    # Spark broadcasts the ids only if it measures them to be few. Rows that repeat are alike; one of them is taken.
    found = rows.join(told, (F.col("mark") == F.col("m")) & F.col("key").eqNullSafe(F.col("k"))).select("id", "text")
    return found.groupBy("id").agg(F.min("text").alias("text"))


def deal_pairs(pairs: DataFrame) -> DataFrame:
    """The pairs with copy_a and copy_b: a text of many pairs is copied once for PAIRS_A_TEXT of them, so that no task gets them all; written."""
    dealt, total = pairs.select("a", "b"), pairs.count()
    for end in ("a", "b"):
        counts = pairs.groupBy(end).agg(F.count("*").alias("n"))
        dealt = lookup(dealt, counts, end, total).withColumn(f"copy_{end}", F.pmod(F.xxhash64("a", "b"), F.ceil(F.col("n") / PAIRS_A_TEXT)).cast("int")).drop("n")
    return materialise(dealt, "neardup-dealt")


def verify(pairs: DataFrame, texts: DataFrame, docs: DataFrame, key: str, text: str, least: float = SIMILARITY) -> DataFrame:
    """The pairs (written ids a, b) whose texts are similar enough, with their similarity; written."""
    both = dealt = deal_pairs(pairs)
    rows = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), texts, docs, key, text)
    for end in ("a", "b"):
        copies = dealt.select(F.col(end).alias("id"), f"copy_{end}").distinct()
        held = copies.join(rows, "id").select(F.col("id").alias(end), f"copy_{end}", F.col("text").alias(f"text_{end}"))
        both = both.hint("merge").join(held, [end, f"copy_{end}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 32):
                b = batch.slice(lo, 32)
                sim = np.array([similarity(x, y, least) for x, y in zip(word_rows(b.column(2)), word_rows(b.column(3)), strict=True)])
                keep = pa.array(sim > 0)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(sim[sim > 0])], ["a", "b", "similarity"])

    links = materialise(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double"), "neardup-links")
    discard(dealt)
    return links


def classes(links: DataFrame, name: str = "classes", most_rounds: int = 60) -> DataFrame:
    """Connected components of the links (a, b): a row (id, class) for each id, class being the least id.

    Large-star and small-star steps in turn, until nothing changes; each round is written to the shared folder.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    before = None
    total = 2 * edges.count()
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = lookup(both, least, "u", total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        large = materialise(large, f"{name}-step")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = lookup(large, low, "u", total).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        old, edges = edges, materialise(small, name)
        discard(old, large)
        release(edges.sparkSession)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, total = now, 2 * now[0]
    else:
        raise RuntimeError("the classes did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("class"))


def unsettled(members: DataFrame, named: DataFrame) -> DataFrame:
    """The members of large buckets that hold several classes, with their class; written."""
    own = members.join(named, "id", "left").withColumn("class", F.coalesce("class", "id"))
    several = own.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("bucket")
    return materialise(own.join(several, "bucket"), "neardup-unsettled")


def hub_pairs(members: DataFrame, links: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """In each bucket of more than PAIRWISE classes, its text of most links (PAIRWISE at least) with the texts of other classes."""
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree")).where(F.col("degree") >= PAIRWISE)
    many = members.select("bucket", "class").distinct().groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > PAIRWISE).select("bucket")
    held = members.join(many, "bucket")
    hubs = held.join(degree, "id").groupBy("bucket").agg(F.max_by(F.struct("id", "class", "words"), F.struct("degree", -F.col("id"))).alias("hub"))
    found = held.join(hubs, "bucket").where((F.col("class") != F.col("hub.class")) & near_length(F.col("words"), F.col("hub.words"), least))
    return found.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()


def pieces(h: np.ndarray, size: int) -> np.ndarray:
    """A code for each run of so many words; none in a shorter row."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        out = out * np.uint64(ta.BASE) + h[j : len(h) - size + 1 + j]
    return ta.mix(out)


def slots(code: np.ndarray) -> np.ndarray:
    """Two counters for each code, one in each row of the table."""
    return np.stack((code % np.uint64(SLOTS), (code >> np.uint64(32)) % np.uint64(SLOTS) + np.uint64(SLOTS))).astype(np.int64)


def key_pieces(h: np.ndarray, common: np.ndarray, least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes and places of pieces of a text, and how many of them any similar, not longer text must hold.

    A row of n words is at most d = (1 - least) * n edits away. Each edit spoils one of its disjoint pieces at most,
    so of any d + m of them m stand in the other text unchanged, at most d places off. m is MEET where there are as
    many. The text is taken two words at a time; of such a pair one piece is the pair or its rarer word, two are both
    words; the d + m pieces of fewest meetings are taken.
    """
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), 1
    most = int((1 - least) * len(h) + 1e-9)
    need = min(len(h), most + MEET)
    met = lambda code: common[slots(code)].min(0).astype(np.float64)
    word, pair = pieces(h, 1), pieces(h, 2)[::2]
    single = met(word)
    if len(h) % 2:
        single = np.append(single, np.inf)
    left, right = single[::2], single[1::2]
    both = np.full(len(left), np.inf)
    both[: len(pair)] = met(pair) if len(pair) else both[:0]
    first = np.minimum(both, np.minimum(left, right))
    second = left + right - first  # what a second piece adds; never less than the first
    cost = np.concatenate((first, second))
    order = np.argsort(cost, kind="stable")[:need]  # in a tie the first piece of a pair of words comes before its second
    one, two = np.zeros(len(left), bool), np.zeros(len(left), bool)
    one[order[order < len(left)]] = True
    two[order[order >= len(left)] - len(left)] = True
    as_pair = one & ~two & (both <= np.minimum(left, right))
    alone = one & ~two & ~as_pair
    places = np.concatenate((np.flatnonzero(two) * 2, np.flatnonzero(two) * 2 + 1, np.flatnonzero(alone) * 2 + (right < left)[alone]))
    return np.concatenate((word[places], pair[as_pair[: len(pair)]])), np.concatenate((places, np.flatnonzero(as_pair) * 2)), need - most


def all_pieces(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes and places of all single words and pairs of words, as ``key_pieces``."""
    one, two = pieces(h, 1), pieces(h, 2)
    return np.concatenate((one, two)), np.concatenate((np.arange(len(one)), np.arange(len(two)))), 1


def ranges(code: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each different code with its first and its last place, how often it stands, and the numbers of the first and the last by place (from 1)."""
    number = np.empty(len(place), np.int64)
    number[np.argsort(place, kind="stable")] = np.arange(1, len(place) + 1)
    order = np.lexsort((place, code))
    code, place, number = code[order], place[order], number[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(code)), bool), code[1:] != code[:-1])))
    end = np.append(first[1:], len(code)).astype(np.int64)[: len(first)]
    return code[first], place[first], place[end - 1], end - first, number[first], number[end - 1]


def in_reach(x: str, y: str, least: float):
    """Whether pieces of the longer text ``x`` may stand in ``y`` where an alignment of at most d edits needs them.

    Of d + m disjoint pieces, numbered by place, and for each j from 1 to m, take the least k with at most k - j edits
    up to the end of piece k: this piece is unspoiled, with just k - j edits before it and at most d - k + j behind.
    These are m different pieces, and such a piece is moved by at most k - 1 places seen from the begin of the texts and
    d - k + m seen from their end; both together by at most d. Codes that repeat are taken by their outermost places.
    """
    v = lambda name: F.col(name).cast("long")
    most = F.floor(v(f"{x}.words") * (1 - least) + 1e-9)
    longer = v(f"{x}.words") - v(f"{y}.words")
    before, behind = v(f"{x}.last_number") - 1, most - v(f"{x}.first_number") + v(f"{x}.meet")
    slack = F.floor((most - longer) / 2)
    low = F.greatest(v(f"{x}.first") - v(f"{y}.last"), -before, longer - behind, -slack)
    high = F.least(v(f"{x}.last") - v(f"{y}.first"), before, longer + behind, longer + slack)
    return (longer >= 0) & (longer <= most) & (low <= high)


def segment_pairs(left: DataFrame, texts: DataFrame, docs: DataFrame, key: str, text: str, least: float = SIMILARITY) -> DataFrame:
    """All pairs of texts of different classes that may be similar: the longer one has key pieces that stand in the other.

    Exact: no similar pair is missing. ``left``: id and class. The table of common pieces only guides which pieces
    are taken, so its collisions cost time, not pairs.
    """
    whole = materialise(texts_of(left.select("id"), texts, docs, key, text).join(left, "id"), "neardup-left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(2 * SLOTS, np.int64)
        for b in batches:
            for h in word_rows(b.column(0)):
                np.add.at(seen, slots(np.unique(all_pieces(h)[0])).ravel(), 1)
        slot = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(seen[slot])], ["slot", "n"])

    counted = whole.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # 2 * SLOTS rows at most
    common = np.zeros(2 * SLOTS, np.int64)
    common[counted["slot"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(common)
    heavy = docs.sparkSession.sparkContext.broadcast(heavy_pieces(whole, shared, least))
    taken = {"keys": lambda h: key_pieces(h, shared.value, least), "all": all_pieces}

    def emit(which: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 32):
                    b = batch.slice(lo, 32)
                    rows = word_rows(b.column(2))
                    chosen = [taken[which](h) for h in rows]
                    held = [held_bits(x[0], heavy.value) for x in chosen]
                    # Heavy pieces go; the others keep their numbers.
                    found = [tuple(v[~np.isin(r[0], heavy.value[0])] for v in r) for r in (ranges(*x[:2]) for x in chosen)]
                    size = [len(x[0]) for x in found]
                    meet = pa.array(np.repeat([x[2] for x in chosen], size), pa.int32())
                    own = [pa.array(np.repeat(b.column(i).to_numpy(), size)) for i in (0, 1)]
                    words = pa.array(np.repeat([len(h) for h in rows], size), pa.int32())
                    code, *spots = (np.concatenate([x[i] for x in found]) for i in range(6))
                    bits = pa.array(np.repeat(np.array(held, np.int64), size))
                    yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), *own, words, *[pa.array(x, pa.int32()) for x in spots], meet, bits], ["code", "id", "class", "words", "first", "last", "times", "first_number", "last_number", "meet", "heavy"])

        return run

    schema = "code long, id long, class long, words int, first int, last int, times int, first_number int, last_number int, meet int, heavy long"
    source = whole.select("id", "class", "text")
    keys, stand = source.mapInArrow(emit("keys"), schema).alias("x"), source.mapInArrow(emit("all"), schema).select("code", "id", "class", "words", "first", "last", "heavy").alias("y")
    met = keys.join(stand, (F.col("x.code") == F.col("y.code")) & (F.col("x.class") != F.col("y.class")) & (F.col("x.heavy").bitwiseAND(F.col("y.heavy")) == 0) & in_reach("x", "y", least))
    enough = met.groupBy(F.col("x.id").alias("x"), F.col("y.id").alias("y")).agg(F.sum("x.times").alias("met"), F.first("x.meet").alias("meet")).where("met >= meet").select("x", "y")
    if len(heavy.value[0]):
        enough = enough.union(heavy_pairs(source, taken, heavy, least))
    pairs = materialise(enough.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "neardup-met")
    return near_bags(pairs, whole, least)


def heavy_pieces(whole: DataFrame, shared, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the key pieces of most meetings, by number of bit, and in how many parts the texts with such a key are dealt."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = np.concatenate([np.zeros(0, np.uint64), *[np.unique(key_pieces(h, shared.value, least)[0]) for h in word_rows(b.column(0))]])
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(shared.value[slots(code)].min(0))], ["code", "common"])

    counted = whole.select("text").mapInArrow(count, "code long, common long").groupBy("code").agg(F.count("*").alias("n"), F.max("common").alias("common"))
    most = counted.where(F.col("n") * F.col("common") >= HEAVY_MEETINGS).orderBy(F.desc(F.col("n") * F.col("common")), "code").limit(HEAVY_CODES).collect()
    return np.array([r["code"] for r in most], np.int64).view(np.uint64), np.array([-(-r["n"] // KEYS_A_COPY) for r in most], np.int32)


def held_bits(code: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> int:
    """The bits of the heavy codes that are among a text's."""
    return sum(1 << int(i) for i in np.flatnonzero(np.isin(heavy[0], code)))


def numbered_words(h: np.ndarray) -> np.ndarray:
    """A four-byte hash for each word with its occurrence number, each once, in text order."""
    seen = (occurrence_labels(h, np.zeros(len(h), np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return seen[np.sort(np.unique(seen, return_index=True)[1])]


def heavy_pairs(source: DataFrame, taken: dict, heavy, least: float) -> DataFrame:
    """Pairs (x, y) of texts of different classes that have a heavy piece in common, a key of the longer one, and enough words for the similarity.

    Whoever shares a heavy piece meets here only, whatever else they share: once, by the first of these pieces, and with
    the bags of words in the condition of the join, so that no row comes out for texts that have the piece alone in
    common. Of words that fall on one hash one is kept, which may only let more pairs through.
    """

    def emit(which: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, parts = heavy.value
            for batch in batches:
                for b in (batch.slice(lo, 32) for lo in range(0, batch.num_rows, 32)):
                    out = []
                    for key, own, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), word_rows(b.column(2)), strict=True):
                        held = held_bits(taken[which](h)[0], heavy.value)
                        bag = numbered_words(h) if held else None
                        out += [(i, int(parts[i]), key, own, len(h), held, bag) for i in range(len(codes)) if held >> i & 1]
                    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["bit", "parts", "id", "class", "words", "heavy", "bag"])

        return run

    schema = "bit int, parts int, id long, class long, words int, heavy long, bag array<int>"
    x = source.mapInArrow(emit("keys"), schema).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).alias("x")
    y = source.mapInArrow(emit("all"), schema).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
    both = F.col("x.heavy").bitwiseAND(F.col("y.heavy"))
    first = both.bitwiseAND(-both) == F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x.bit"))
    most = F.floor(F.col("x.words") * (1 - least) + 1e-9)
    longer = F.col("x.words") - F.col("y.words")
    alike = F.size(F.array_intersect("x.bag", "y.bag")) >= F.size("x.bag") - most
    met = x.join(y, (F.col("x.bit") == F.col("y.bit")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.class") != F.col("y.class")) & (longer >= 0) & (longer <= most) & first & alike)
    return met.select(F.col("x.id").alias("x"), F.col("y.id").alias("y"))


def near_bags(pairs: DataFrame, whole: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) that have enough words in common for the similarity; no similar pair is left out. ``whole``: id and text.

    The words of few texts are broadcast as sorted hashes, so that pairs which only share a common passage do not meet
    as texts. Where there are more, all pairs stay, and ``verify`` counts the words when it has the texts.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 32):
                b = batch.slice(lo, 32)
                rows = word_rows(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(h) for h in rows], pa.int32()), pa.array([np.sort((h >> np.uint64(32)).astype(np.uint32)).tobytes() for h in rows], pa.binary())], ["id", "words", "bag"])

    marks = materialise(whole.select("id", "text").mapInArrow(mark, "id long, words int, bag binary"), "neardup-bags")
    if (marks.agg(F.sum("words")).first()[0] or 0) > MOST_WORDS:
        return pairs
    told = marks.toPandas()
    held = pairs.sparkSession.sparkContext.broadcast(dict(zip(told["id"].tolist(), told["bag"].tolist(), strict=True)))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag = lambda i: np.frombuffer(held.value[i], np.uint32)
        for b in batches:
            keep = []
            for x, y in zip(*(map(bag, b.column(i).to_pylist()) for i in (0, 1)), strict=True):
                long = max(len(x), len(y))
                keep.append(long - common_words(x, y) <= int((1 - least) * long + 1e-9))
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])

    return pairs.mapInArrow(near, "a long, b long")


def settled_classes(shared: DataFrame, members: DataFrame, texts: DataFrame, docs: DataFrame, key: str, text: str, least: float = SIMILARITY) -> DataFrame:
    """``classes`` of the links of all pairs that share a bucket: every such pair is compared, or joined by links already, or too unlike to be similar."""
    done = materialise(candidate_pairs(shared, members, least), "neardup-pairs")
    discard(shared)
    links = verify(done, texts, docs, key, text, least)
    named = classes(links, "neardup-classes")
    for step in ("hubs", "segments"):
        release(docs.sparkSession)
        left = unsettled(members, named)
        if left.isEmpty():
            break
        found = hub_pairs(left, links, least) if step == "hubs" else segment_pairs(left.select("id", "class").distinct(), texts, docs, key, text, least)
        more = materialise(found.join(done, ["a", "b"], "left_anti"), "neardup-pairs")
        new = None if more.isEmpty() else verify(more, texts, docs, key, text, least)
        if new is not None and not new.isEmpty():
            named = classes(named.select(F.col("id").alias("a"), F.col("class").alias("b")).union(new.select("a", "b")), "neardup-classes")
        done = done.union(more)
    return named


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY, sketches: int = SKETCHES, ordered: int = ORDERED) -> DataFrame:
    """For each row: key, mark (xxhash64 of the text), class (null for a text without words), class_id and same_as as in
    ``near_duplicates``, and stays: whether (key, mark) is what stays of the class. Rows with equal key and text are alike here."""
    seen = materialise(sketch_texts(docs, key, text, sketches, ordered), "neardup-sketches")
    told = seen.where(F.col("same").isNotNull())
    # The order in which one of several rows is taken: those with a key first.
    rank = F.struct(F.col("key").isNull().alias("no_key"), "key", "mark")
    grouped = told.groupBy("same").agg(F.first("words").alias("words"), F.first("buckets").alias("buckets"), F.min(rank).alias("rep"), F.count("*").alias("n"))
    sketched = materialise(grouped.withColumn("id", F.monotonically_increasing_id()), "neardup-texts")
    # From here on rows and texts are kept without their sketches, which are the largest tables.
    rows = materialise(seen.select("key", "mark", "same"), "neardup-rows")
    discard(seen)
    told = rows.where(F.col("same").isNotNull())
    shared = shared_buckets(sketched)
    members = large_members(shared, sketched)
    texts = materialise(sketched.drop("buckets"), "neardup-ids")
    discard(sketched)
    release(docs.sparkSession)
    named = settled_classes(shared, members, texts, docs, key, text, least)
    placed = texts.select("same", "n", "rep", "id").join(named, "id", "left").withColumn("class", F.coalesce("class", "id"))
    placed = materialise(placed, "neardup-placed")
    best = placed.groupBy("class").agg(F.min("rep").alias("best"), F.count("*").alias("n"))
    placed = lookup(placed.select("same", F.col("n").alias("rows"), "rep", "class"), best, "class", placed.count())
    placed = materialise(placed.select("same", F.col("rows").alias("n"), "class", "best", "rep"), "neardup-named")
    out = lookup(told.select("key", "mark", "same"), placed, "same", rows.count())
    stays = F.col("key").eqNullSafe(F.col("best.key")) & (F.col("mark") == F.col("best.mark"))
    out = out.select("key", "mark", "class", F.col("best.key").alias("class_id"), F.col("rep.key").alias("same_as"), stays.alias("stays"))
    lone = rows.where(F.col("same").isNull()).select("key", "mark", F.lit(None).cast("long").alias("class"), F.col("key").alias("class_id"), F.col("key").alias("same_as"), F.lit(True).alias("stays"))
    return out.union(lone)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY, sketches: int = SKETCHES, ordered: int = ORDERED) -> DataFrame:
    """A row for each row of ``docs``: key, class_id (the least key of its class), same_as (the least key of an equal text).

    A text without words (null, empty, punctuation only) is in a class of its own. Rows of one key with different
    texts are separate documents; rows without a key are compared like others, and a class of such rows alone has a
    null class_id. No document leaves the result.
    """
    return classify(docs, key, text, least, sketches, ordered).select(F.col("key").alias(key), "class_id", "same_as")


def without_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class of near duplicates: that of the least key, or without any key that of the least hash.

    Texts without words all stay. Only rows that go, or that repeat, meet ``docs`` in a join, and only rows that may be among them move.
    """
    seen = materialise(classify(docs, key, text, **options).select("key", "mark", "class", "stays"), "neardup-decisions")
    gone = seen.where(~F.col("stays")).select("key", "mark").distinct()
    twice = seen.where(F.col("stays") & F.col("class").isNotNull()).groupBy("key", "mark").count().where("count > 1").select("key", "mark")
    told = materialise(gone.withColumn("repeats", F.lit(False)).union(twice.withColumn("repeats", F.lit(True))).select(F.col("key").alias("_k"), F.col("mark").alias("_m"), F.col("repeats").alias("_repeats")), "neardup-gone")
    same = F.col(key).cast("long").eqNullSafe(F.col("_k")) & (F.xxhash64(F.col(text)) == F.col("_m"))
    parted = by_mark(docs.withColumn("_mark", F.xxhash64(F.col(text))), "_mark", told.select("_m"))
    kept = parted.where(~F.col("_may")).select(*docs.columns).union(parted.where("_may").select(*docs.columns).join(told, same, "left_anti"))
    again = told.where("_repeats")
    if again.isEmpty():
        return kept
    one = docs.join(again, same).groupBy("_k", "_m").agg(*[F.first(F.struct(*docs.columns)).alias("row")]).select("row.*")
    return kept.union(one)


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all ``documents``: doc_id, class_id, same_as."""
    return near_duplicates(table(spark, sf_dir, "documents"))
