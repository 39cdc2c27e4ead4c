"""Preference formatting: a prompt shared by a chosen and a rejected conversation, and their masked completions.

The longest common prefix of turns (same role and text) is rendered once as the prompt. What each conversation has
beyond it is its completion, in which the text of assistant turns bears loss; the mask is given as ranges of code
points. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm.base import table

ASSISTANT = "assistant"


def opening(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


CLOSING = "<|end|>\n"


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(opening(t), t["text"], F.lit(CLOSING))), "")


def loss_ranges(turns: Column) -> Column:
    """start:end of the assistant texts with their closing mark, comma-joined; code points of the rendered turns, end exclusive."""
    state = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<string>").alias("ranges"))

    def step(acc: Column, t: Column) -> Column:
        begin = (acc["at"] + F.char_length(opening(t))).cast("int")
        end = (begin + F.char_length(t["text"]) + len(CLOSING)).cast("int")
        return F.struct(end.alias("at"), F.when(t["role"] == ASSISTANT, F.concat(acc["ranges"], F.array(F.concat_ws(":", begin, end)))).otherwise(acc["ranges"]).alias("ranges"))

    return F.array_join(F.aggregate(turns, state, step, lambda acc: acc["ranges"]), ",")


def conversation_rows(turns: DataFrame, key: str) -> DataFrame:
    """A row for each conversation with its turns in order; a null role or text is empty, repeated turns stay, ordered by role and text."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy(F.col(key).alias("pair")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_preferences(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """A row for each pair: key, prefix_turns, prompt, chosen, rejected, chosen_loss, rejected_loss, differs.

    Both inputs have key, turn, role and text. A pair that lacks a side gives no row, nor does a null key. Equal
    conversations have empty completions and differs false. A turn's number orders it but is not compared.
    """
    both = conversation_rows(chosen, key).join(conversation_rows(rejected, key).withColumnRenamed("turns", "others"), "pair")
    same = F.zip_with(F.col("turns"), F.col("others"), lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    at = F.array_position(same, False).cast("int")
    both = both.withColumn("prefix", F.when(at == 0, F.least(F.size("turns"), F.size("others"))).otherwise(at - 1))
    rest, others = F.slice("turns", F.col("prefix") + 1, F.size("turns")), F.slice("others", F.col("prefix") + 1, F.size("others"))
    both = both.withColumns({"shared": F.slice("turns", F.lit(1), F.col("prefix")), "rest": rest, "other_rest": others})
    return both.select(
        F.col("pair").alias(key), F.col("prefix").cast("long").alias("prefix_turns"), rendered(F.col("shared")).alias("prompt"),
        rendered(F.col("rest")).alias("chosen"), rendered(F.col("other_rest")).alias("rejected"),
        loss_ranges(F.col("rest")).alias("chosen_loss"), loss_ranges(F.col("other_rest")).alias("rejected_loss"),
        ((F.size("rest") > 0) | (F.size("other_rest") > 0)).alias("differs"),
    )


def swapped_answers(turns: DataFrame, key: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected conversations from plain ones: each up to its last assistant turn, and the same with that
    turn's text taken from the last assistant turn of the conversation with the next number (empty without one)."""
    answers = turns.where(F.col("role") == ASSISTANT).groupBy(key).agg(F.max("turn").alias("last"), F.max_by(F.coalesce("text", F.lit("")), F.struct("turn", "text")).alias("answer"))
    donors = answers.select((F.col(key) - 1).alias(key), F.col("answer").alias("other"))
    cut = turns.join(answers.select(key, "last").join(donors, key, "left"), key).where(F.col("turn") <= F.col("last"))
    chosen = cut.select(F.col(key).alias("pair_id"), "turn", "role", "text")
    swap = (F.col("turn") == F.col("last")) & (F.col("role") == ASSISTANT)
    return chosen, cut.select(F.col(key).alias("pair_id"), "turn", "role", F.when(swap, F.coalesce("other", F.lit(""))).otherwise(F.col("text")).alias("text"))


def op8_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference rows from all ``conversations`` that have an assistant turn."""
    chosen, rejected = swapped_answers(table(spark, sf_dir, "conversations"))
    return format_preferences(chosen, rejected).withColumnRenamed("pair_id", "conv_id")


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS raw_role FROM conversations),
a AS (SELECT conv_id, max(turn) AS last, arg_max(text, struct_pack(turn := turn, text := text)) AS answer FROM t WHERE raw_role = 'assistant' GROUP BY conv_id),
cut AS (SELECT t.conv_id, t.turn, t.role, t.text, CASE WHEN t.turn = a.last AND t.raw_role = 'assistant' THEN coalesce(d.answer, '') ELSE t.text END AS other
  FROM t JOIN a USING (conv_id) LEFT JOIN a d ON d.conv_id = t.conv_id + 1 WHERE t.turn <= a.last),
c AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM cut),
r AS (SELECT conv_id, role, other AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, other) AS k FROM cut),
p AS (SELECT c.conv_id, coalesce(min(CASE WHEN c.role <> r.role OR c.text <> r.text THEN c.k END), count(*) + 1) - 1 AS n FROM c JOIN r USING (conv_id, k) GROUP BY c.conv_id),
pieces AS (SELECT 'c' AS side, * FROM c UNION ALL SELECT 'r', * FROM r),
laid AS (SELECT side, conv_id, k, n, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS piece, length(role) + 5 AS head FROM pieces JOIN p USING (conv_id)),
placed AS (SELECT *, sum(length(piece)) OVER (PARTITION BY side, conv_id, k <= n ORDER BY k) AS stop FROM laid)
SELECT conv_id, CAST(any_value(n) AS BIGINT) AS prefix_turns,
  coalesce(string_agg(piece, '' ORDER BY k) FILTER (WHERE side = 'c' AND k <= n), '') AS prompt,
  coalesce(string_agg(piece, '' ORDER BY k) FILTER (WHERE side = 'c' AND k > n), '') AS chosen,
  coalesce(string_agg(piece, '' ORDER BY k) FILTER (WHERE side = 'r' AND k > n), '') AS rejected,
  coalesce(string_agg(CAST(stop - length(piece) + head AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY k) FILTER (WHERE side = 'c' AND k > n AND role = 'assistant'), '') AS chosen_loss,
  coalesce(string_agg(CAST(stop - length(piece) + head AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY k) FILTER (WHERE side = 'r' AND k > n AND role = 'assistant'), '') AS rejected_loss,
  count(*) FILTER (WHERE k > n) > 0 AS differs
FROM placed GROUP BY conv_id
"""
