"""Fill-in-middle by counted quantifiers: one match of a pattern made for each row cuts a text in three.

``regexp_count`` gives the n units of a text (code points, unless another pattern is given). Two cuts a <= b follow
from a hash of the key, and the row's own pattern, possessive groups of exactly a and b - a units and a group of the
rest, captures prefix, middle and suffix in one match, whose replacement writes them in the order of the form.
Possessive groups neither backtrack nor recurse, so a text of any length takes linear time and no stack.

Forms: psm is P prefix S suffix M middle, spm is S suffix P prefix M middle, and plain is the text itself: an empty
text, one that holds a sentinel (its output could not be read back), or a share of all texts, by the hash.
A text without sentinels is read back from output and form alone, since sentinels begin with a character that they
hold nowhere else and so cannot overlap.

Rows are handled by themselves, by functions within the JVM: no shuffle, no Python. Null texts are empty; a null key
counts as an empty one; repeated rows give repeated rows; other columns are not looked at; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm.base import table

#: Code points as units.
CODE_POINT = "."
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN_PERCENT, SPM_PERCENT, SEED = 10, 20, 1
#: Units counted by one match; ``regexp_count`` gathers its matches, so single units would take an object each.
BLOCK_UNITS = 256


def count_units(text: Column, unit: str = CODE_POINT) -> Column:
    """How many units a text has, matched from left to right: whole blocks, and the units of what blocks leave."""
    block = F.lit(f"(?s)(?:{unit}){{{BLOCK_UNITS}}}+")
    return F.regexp_count(text, block).cast("long") * BLOCK_UNITS + F.regexp_count(F.regexp_replace(text, block, F.lit("")), F.lit(f"(?s)(?:{unit})"))


def cut_pattern(prefix: Column, middle: Column, unit: str = CODE_POINT) -> Column:
    """The pattern of a row: groups of exactly ``prefix`` and ``middle`` units, and of the rest."""
    return F.concat(F.lit(f"(?s)\\A((?:{unit}){{"), prefix.cast("string"), F.lit(f"}}+)((?:{unit}){{"), middle.cast("string"), F.lit("}+)(.*+)\\z"))


def _quoted(sentinel: str) -> str:
    return sentinel.replace("\\", "\\\\").replace("$", "\\$")


def _hashes(key: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from a key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = CODE_POINT, sentinels: tuple[str, str, str] = SENTINELS, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED) -> DataFrame:
    """A row for each row of ``docs``: key, text, n, form, prefix_units, middle_units (null if plain), output."""
    p, s, m = sentinels
    if not all(sentinels) or len({*sentinels}) < 3 or any(x[0] in y[1:] or (x != y and y.startswith(x)) for x in sentinels for y in sentinels):
        raise ValueError("no sentinel may begin another, or hold the first character of one after its own first")
    whole = F.coalesce(F.col(text), F.lit(""))
    h = _hashes(F.col(key), seed)
    rows = docs.select(F.col(key), whole.alias("text"), *[x.alias(f"h{i}") for i, x in enumerate(h, 1)])
    rows = rows.withColumn("n", count_units(F.col("text"), unit))
    cut = [F.col(x) % (F.col("n") + 1) for x in ("h1", "h2")]
    holds = [F.contains(F.col("text"), F.lit(x)) for x in sentinels]
    plain = (F.col("n") == 0) | holds[0] | holds[1] | holds[2] | (F.col("h3") % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select(key, "text", "n", form.alias("form"), F.least(*cut).alias("a"), F.greatest(*cut).alias("b"))
    told = F.when(F.col("form") == "psm", f"{_quoted(p)}$1{_quoted(s)}$3{_quoted(m)}$2").otherwise(f"{_quoted(s)}$3{_quoted(p)}$1{_quoted(m)}$2")
    cutting = F.regexp_replace(F.col("text"), cut_pattern(F.col("a"), F.col("b") - F.col("a"), unit), told)
    only = lambda value: F.when(F.col("form") != "plain", value)
    return rows.select(key, "text", "n", "form", only(F.col("a")).alias("prefix_units"), only(F.col("b") - F.col("a")).alias("middle_units"), F.when(F.col("form") == "plain", F.col("text")).otherwise(cutting).alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text, from an output and its form alone."""
    p, s, m = (f"\\Q{x}\\E" for x in sentinels)
    back = lambda first, second, order: F.regexp_replace(output, F.lit(f"(?s)\\A{first}(.*?){second}(.*?){m}(.*+)\\z"), F.lit(order))
    return F.when(form == "psm", back(p, s, "$1$3$2")).when(form == "spm", back(s, p, "$2$3$1")).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` cut over code points; digests of the outputs and of the texts read back from them."""
    rows = fill_in_middle(table(spark, sf_dir, "documents")).withColumn("again", restored(F.col("output"), F.col("form")))
    return rows.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2("again", 256).alias("restored_sha256"))


ORACLE = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, CAST(concat('0x', d[1:8]) AS BIGINT) AS h1, CAST(concat('0x', d[9:16]) AS BIGINT) AS h2,
  CAST(concat('0x', d[17:24]) AS BIGINT) AS h3, CAST(concat('0x', d[25:32]) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1, n - b) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""
