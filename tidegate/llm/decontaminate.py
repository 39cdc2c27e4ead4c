"""Benchmark decontamination by template canonicalisation.

Numbers, units after them and names (capitalised words within a sentence) become typed placeholders; what is left is
lower-cased words. A capitalised word that opens a sentence may be a name or not, so windows with such words are taken
in both readings. Windows of WINDOW tokens of the benchmark items are joined by hash with the windows of documents.
A document leaks an item if it holds at least the share SHARE of the item's windows, in either reading, and the values
in the slots are consistent: the item's values and the document's correspond one to one in at least the share
CONSISTENT of the slots. So a question with other numbers and names is caught and a chance match of placeholders is
not. An item without a window of LEAST_WORDS words (short, or mostly slots) is looked up whole, by the hash of all its
tokens, and only with its own values.

DataFrame functions only. A document that holds the share of an item's windows holds one of any (1 - share) of them and
one more, so only an item's rarest windows are keys, and common windows are counted for candidates alone. Keys are
broadcast if they are counted to be few, else both sides are shuffled by the window's hash. Texts of documents are
never shuffled for the search; windows and slots are looked up in the candidate documents alone.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.llm.base import let, materialise, table

WINDOW, SHARE = 5, 0.8
#: Words, not placeholders, that a window must hold to count.
LEAST_WORDS = 3
#: Share of slots that must follow one mapping of values.
CONSISTENT = 0.8
#: Windows of the benchmark up to which they are broadcast (about 32 bytes each).
BROADCAST_WINDOWS = 1_000_000

#: Units of measure and money.
UNITS = "kg g mg t lb lbs oz km m cm mm mi miles ft in l ml h hours hour hrs min minutes minute s sec seconds second days day weeks week months month years year percent % dollars dollar euros euro cents usd eur € $ °c °f"
_OPEN, _SHUT = "\ue000", "\ue001"  # private-use characters
NUMBER = r"\p{N}+(?:[.,]\p{N}+)*"
NAME = rf"\p{{Lu}}(?<=[\p{{L}}\p{{M}}{_SHUT},;:]\x20\p{{Lu}})[\p{{Ll}}\p{{M}}]+(?![\p{{L}}\p{{M}}])"
#: Any other capitalised word: it opens a sentence or a line, or follows a quote, a bracket or a full stop.
OPENER = r"\p{Lu}(?<![\p{L}\p{M}]\p{Lu})[\p{Ll}\p{M}]+(?![\p{L}\p{M}])"
TOKEN = rf"{_OPEN}[^{_SHUT}]*{_SHUT}|[\p{{L}}\p{{M}}]+"


def marked(text: Column) -> Column:
    """The text in lower case, slots between marks with their type (n, u or a; o: may be a name) and value."""
    units = "|".join(sorted(("\\" + u if u in "$" else u for u in UNITS.split()), key=len, reverse=True))
    clean = F.when(F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_SHUT)), F.regexp_replace(text, f"[{_OPEN}{_SHUT}]", " ")).otherwise(text)
    numbers = F.regexp_replace(clean, NUMBER, f"{_OPEN}n$0{_SHUT}")
    with_units = F.regexp_replace(numbers, rf"(?<={_SHUT})\x20?({units})(?![\p{{L}}\p{{N}}])", f" {_OPEN}u$1{_SHUT}")
    names = F.regexp_replace(with_units, NAME, f"{_OPEN}a$0{_SHUT}")
    return F.lower(F.regexp_replace(names, OPENER, f"{_OPEN}o$0{_SHUT}"))


def tokens(text: Column) -> Column:
    """Words, and slots with their marks."""
    return F.regexp_extract_all(marked(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def kind_of(token: Column) -> Column:
    """The mark and type of a slot; the first characters of a word."""
    return F.substring(token, 1, 2)


def is_slot(token: Column) -> Column:
    return F.startswith(token, F.lit(_OPEN)) & ~F.startswith(token, F.lit(_OPEN + "o"))


def bare(token: Column) -> Column:
    return F.regexp_replace(token, f"^{_OPEN}[a-z]|{_SHUT}$", "")


#: Readings of capitalised words: openers as words, openers as names, and all of them as words.
READINGS = ("plain", "named", "literal")


def token_codes(found: Column, reading: str = "plain") -> Column:
    """A number for each token: a hash of a word, or of a slot's type alone."""
    name, opener = F.lit(_OPEN + "a"), F.lit(_OPEN + "o")

    def code(t: Column) -> Column:
        out = F.when(F.startswith(t, opener), F.xxhash64(name) if reading == "named" else F.xxhash64(bare(t)))
        if reading == "literal":
            out = out.when(F.startswith(t, name), F.xxhash64(bare(t)))
        return out.when(is_slot(t), F.xxhash64(kind_of(t))).otherwise(F.xxhash64(t))

    return F.transform(found, code)


def window_codes(codes: Column, size: int = WINDOW) -> Column:
    """A hash for each window; none in a text of fewer tokens."""
    none = F.array().cast("array<bigint>")
    return let(codes, lambda c: F.when(F.size(c) < size, none).otherwise(F.transform(F.sequence(F.lit(0), F.size(c) - size), lambda i: F.xxhash64(*[F.get(c, i + j) for j in range(size)]))))


def document_windows(found: Column, sizes: tuple[int, ...] = (WINDOW,)) -> Column:
    """All different windows of a document, in all readings that its capitalised words allow."""
    has = lambda t, kind: F.exists(t, lambda x: F.startswith(x, F.lit(_OPEN + kind)))
    one = lambda t, reading: F.concat(*[window_codes(token_codes(t, reading), n) for n in sizes])
    none = F.array().cast("array<bigint>")
    return let(found, lambda t: F.array_distinct(F.concat(one(t, "plain"), F.when(has(t, "o"), one(t, "named")).otherwise(none), F.when(has(t, "a"), one(t, "literal")).otherwise(none))))


def numbered_items(items: DataFrame, item_key: str, text: str) -> DataFrame:
    """item (a number), item_key, text: each row of the benchmark is an item, whatever its key; rows equal in both are one. Written, so that the numbers stay."""
    told = items.select(F.col(item_key).alias("item_key"), F.col(text).alias("text")).distinct()
    return materialise(told.select(F.monotonically_increasing_id().alias("item"), "item_key", "text"), "leak-items")


def item_windows(items: DataFrame, item_key: str, text: str, size: int = WINDOW) -> DataFrame:
    """item, found (its tokens), at, code, whole: the windows that count, in two readings. Copies of an item stay apart.

    An item without such a window has one of all its tokens (whole). An item without tokens has none.
    """
    told = items.select(F.col(item_key).alias("item"), tokens(F.col(text)).alias("found")).where(F.size("found") > 0)
    words = lambda at: F.size(F.filter(F.slice("found", at + 1, F.lit(size)), lambda t: ~is_slot(t)))
    each = [told.select("item", "found", F.posexplode(window_codes(token_codes(F.col("found"), reading), size)).alias("at", "code")) for reading in READINGS[:2]]
    rows = materialise(each[0].union(each[1]).where(words(F.col("at")) >= LEAST_WORDS).distinct().withColumn("whole", F.lit(False)), "leak-parts")
    rest = told.join(rows.select("item").distinct(), "item", "left_anti")
    every = F.xxhash64(F.lit("all"), F.size("found"), token_codes(F.col("found")))
    return rows.union(rest.select("item", "found", F.lit(0).alias("at"), every.alias("code"), F.lit(True).alias("whole")))


def key_windows(windows: DataFrame, share: float) -> DataFrame:
    """item and code of the rarest windows of each item, of which a document that holds the share must hold one."""
    common = windows.groupBy("code").agg(F.count_distinct("item").alias("items"))
    places = windows.join(common, "code").groupBy("item", "at").agg(F.max("items").alias("items"), F.collect_set("code").alias("codes"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("items", "at"))
    total = F.count("*").over(Window.partitionBy("item"))
    keys = places.select("item", "codes", rank.alias("rank"), total.alias("n")).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1)
    return keys.select("item", F.explode("codes").alias("code")).distinct()


def whole_windows(found: Column, sizes: list[int]) -> Column:
    """The codes of runs of so many tokens, as of items that are looked up whole."""
    run = lambda c, n: F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.xxhash64(F.lit("all"), F.lit(n), F.slice(c, i + 1, F.lit(n))))
    none = F.array().cast("array<bigint>")
    return let(token_codes(found), lambda c: F.concat(none, *[F.when(F.size(c) < n, none).otherwise(run(c, n)) for n in sizes]))


def find_candidates(docs: DataFrame, windows: DataFrame, key: str, text: str, share: float, size: int = WINDOW) -> DataFrame:
    """doc, mark (a hash of the text) and item for each pair that shares a key window."""
    keys = materialise(key_windows(windows.where("NOT whole"), share).union(windows.where("whole").select("item", "code")), "leak-keys")
    small = keys.count() <= BROADCAST_WINDOWS
    hint = F.broadcast if small else (lambda df: df)
    # Lengths of the items that are looked up whole; there are few, and seldom any.
    sizes = sorted(r[0] for r in windows.where("whole").select(F.size("found")).distinct().collect())
    own = let(tokens(F.col(text)), lambda t: F.concat(document_windows(t, (size,)), F.array_distinct(whole_windows(t, sizes)))) if sizes else document_windows(tokens(F.col(text)), (size,))
    seen = docs.select(F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("mark"), F.explode(own).alias("code"))
    return seen.join(hint(keys), "code").select("doc", "mark", "item").distinct()


def check(docs: DataFrame, windows: DataFrame, candidates: DataFrame, key: str, text: str, size: int = WINDOW) -> DataFrame:
    """candidates with share, slots, changed and agreeing: the share of the item's windows that the document holds, how
    many slots there are, how many have another value, and how many are in a one-to-one correspondence of values.

    A document and an item are aligned by the distance of places that most of their common windows have.
    """
    pair = ["doc", "mark", "item"]
    # Candidates are written already, so the plan knows their size and broadcasts them only if they are small.
    rows = docs.select(F.col(key).alias("own_key"), F.xxhash64(F.col(text)).alias("own_mark"), F.col(text).alias("the_text"))
    met = rows.join(candidates, F.col("own_key").eqNullSafe(F.col("doc")) & (F.col("own_mark") == F.col("mark"))).select(*pair, tokens(F.col("the_text")).alias("own"))
    texts = materialise(met.groupBy(*pair).agg(F.min("own").alias("own")).withColumn("pair", F.monotonically_increasing_id()), "leak-tokens")
    parts = [texts.select("pair", "item", F.posexplode(window_codes(token_codes(F.col("own"), reading), size)).alias("place", "code")) for reading in READINGS]
    lengths = sorted(r[0] for r in windows.where("whole").select(F.size("found")).distinct().collect())
    parts += [texts.select("pair", "item", F.posexplode(whole_windows(F.col("own"), [n])).alias("place", "code")) for n in lengths]
    places = functools.reduce(DataFrame.union, parts)
    common = materialise(places.join(windows.select("item", "code", "at"), ["item", "code"]).select("pair", "item", "place", "at").distinct(), "leak-common")
    totals = windows.groupBy("item").agg(F.count_distinct("at").alias("windows"), F.max("whole").alias("whole"))
    shares = common.groupBy("pair", "item").agg(F.count_distinct("at").alias("n")).join(totals, "item").select("pair", "whole", (F.col("n") / F.col("windows")).alias("share"))
    shifts = common.groupBy("pair", (F.col("place") - F.col("at")).alias("shift")).agg(F.count_distinct("at").alias("n"))
    best = shifts.groupBy("pair").agg(F.max_by("shift", F.struct("n", -F.col("shift"))).alias("shift"))
    typed = lambda t: F.when(F.startswith(t, F.lit(_OPEN + "o")), F.lit(_OPEN + "a")).otherwise(kind_of(t))
    slots = windows.select("item", "found").distinct().select("item", F.posexplode("found").alias("at", "value")).where(F.startswith("value", F.lit(_OPEN)))
    held = texts.join(best, "pair").join(slots, "item").select("pair", "value", F.get("own", F.col("at") + F.col("shift")).alias("other"))
    held = held.where(F.startswith("other", F.lit(_OPEN)) & (typed(F.col("other")) == typed(F.col("value")))).select("pair", typed(F.col("value")).alias("kind"), bare(F.col("value")).alias("value"), bare(F.col("other")).alias("other"))
    counts = held.groupBy("pair", "kind", "value", "other").agg(F.count("*").alias("n"))
    first = lambda c, o: F.row_number().over(Window.partitionBy("pair", "kind", c).orderBy(F.desc("n"), o)) == 1
    ranked = counts.select("*", first("value", "other").alias("mine"), first("other", "value").alias("its"))
    told = ranked.groupBy("pair").agg(F.sum("n").alias("slots"), F.sum(F.when(F.col("other") != F.col("value"), F.col("n")).otherwise(0)).alias("changed"), F.sum(F.when(F.col("mine") & F.col("its"), F.col("n")).otherwise(0)).alias("agreeing"))
    zero = F.lit(0).cast("long")
    return texts.join(shares, "pair").join(told, "pair", "left").select(*pair, "whole", "share", *[F.coalesce(c, zero).alias(c) for c in ("slots", "changed", "agreeing")])


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", share: float = SHARE, consistent: float = CONSISTENT, size: int = WINDOW) -> DataFrame:
    """A row for each document (doc, and mark: the hash of its text) and item that it leaks, with share, slots, changed and kind."""
    numbered = numbered_items(items, item_key, item_text)
    windows = materialise(item_windows(numbered, "item", "text", size), "leak-windows")
    candidates = materialise(find_candidates(docs, windows, key, text, share, size), "leak-candidates")
    seen = check(docs, windows, candidates, key, text, size)
    sure = (F.col("share") >= share - 1e-9) & (F.col("agreeing") >= F.col("slots") * consistent - 1e-9) & (~F.col("whole") | (F.col("changed") == 0))
    kind = F.when(F.col("changed") == 0, "exact").otherwise("reparameterised")
    return seen.where(sure).join(numbered.select("item", "item_key"), "item").select("doc", "mark", F.col("item_key").alias("item"), "share", "slots", "changed", kind.alias("kind"))


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", **options) -> DataFrame:
    """A row for each document and item that it leaks: key, item key, share, slots, changed, kind.

    kind is exact (no slot has another value) or reparameterised. A null or empty text leaks nothing. Rows are
    documents by themselves, whatever their keys; rows equal in key and text give one row of the result. So are rows of
    the benchmark: an item without a key is found (its key is null), items of one key are found each by itself, and
    items without tokens leak nothing. Other columns are not looked at; an empty table on either side gives none.
    """
    found = leaks(docs, items, key, text, item_key, item_text, **options)
    return found.select(F.col("doc").alias(key), F.col("item").alias(item_key), "share", "slots", "changed", "kind")


def without_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that leak an item."""
    found = materialise(leaks(docs, items, key, text, **options).select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark")).distinct(), "leak-rows")
    return docs.join(found, F.col(key).eqNullSafe(F.col("_doc")) & (F.xxhash64(F.col(text)) == F.col("_mark")), "left_anti")


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that leak an item of ``benchmark``, with the item."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
