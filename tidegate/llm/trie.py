"""The prefix trie of conversations by an Euler tour.

A node is a distinct sequence of first turns. Its name (``conv_id``, ``depth``) is its smallest member and its length,
which no other node has. Nodes come from one aggregate over the turns: a turn's prefix is known by sums of hashes of
(position, content) over the turns up to it, sums that ranges of a long conversation add up by themselves.

Each node has an arc into it and an arc out of it; the tour goes from an arc in to the first child's arc in (or to
the node's own arc out), from an arc out to the next sibling's arc in (or to the parent's arc out). Children follow
each other by name: the next sibling is a neighbour in a global sort, so a parent of any number of children is split
between blocks. The tour is a linked list of two arcs a node, which ``listrank.rank`` ranks; the sums before a node's
two arcs differ by what its subtree holds: leaves and savings.

Scale. Texts are hashed in the scan and never shuffled. Conversations of any length are sorted in blocks (ranges of
conversation and turn), with sums carried from block to block; a parent of very many children is joined apart; the
members that end at a node are hashed as a stream of chunks in order, each the members of one range of ids.

Rows without conv_id belong to no conversation and are left out. Turns of equal number follow by a hash of role and
text; repeated rows are turns of their own; null roles and texts are empty; other columns are not looked at. An empty
table has no node.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.llm import listrank
from tidegate.llm.base import lookup, materialise, small_batches, table

#: Rows of a block of sorted turns or siblings.
BLOCK_ROWS = 100_000
#: Openings: conversations of one hundred share the first turns of its least id, up to MOST_SHARED - 1 of them.
SHARED_BY, MOST_SHARED = 100, 6
SUMS = ("s1", "s2", "s3", "s4")
NODE = ("g1", "g2", "depth")


def in_blocks(rows: DataFrame, name: str, *order: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Written rows dealt to ranges of about ``block_rows``; ``block`` numbers the ranges in order."""
    blocks = max(1, math.ceil(rows.count() / block_rows))
    return materialise(rows.repartitionByRange(blocks, *order).withColumn("block", F.spark_partition_id()), name)


def turn_rows(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Turns in blocks: conv_id, turn, content (16 bytes of a digest of role and text), chars, block."""
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in ("role", "text"))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), "turn", F.unhex(F.substring(digest, 1, 32)).alias("content"), F.char_length(text).cast("long").alias("chars"))
    return in_blocks(materialise(rows, "trie-turns"), "trie-blocks", "conv_id", "turn", "content", block_rows=block_rows)


def _carried(parts: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Of a row for each (block, conv_id): the sums of the earlier blocks of the conversation, named ``had_``.

    A conversation in several blocks fills those between its first and last, so these parts are fewer than twice the blocks.
    """
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("block", "conv_id", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"had_{v}") for v in values])


def share_openings(turns: DataFrame, shared_by: int = SHARED_BY, most: int = MOST_SHARED) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt with the first h turns of the least id of their hundred, h = crc32(id) % ``most``.

    Returns their turns with sums over the turns up to each (conv_id, pos, chars, last, sums, and ``own_`` the turn's
    part of them), and the conversations (conv_id), turnless ones as well. With ``most`` = 1 nothing is shared.
    """
    c = F.col
    parts = _sized(turns)
    numbered = Window.partitionBy("block", "conv_id").orderBy("turn", "content")
    place = (F.row_number().over(numbered) + c("had_n")).alias("i")
    bases = turns.where(c("conv_id") % shared_by == 0).join(parts, ["block", "conv_id"]).select("conv_id", "content", "chars", place).where(c("i") < most)
    heads = bases.groupBy(c("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("i", "content", "chars"))).alias("opening"))
    convs = parts.groupBy("conv_id").agg(F.max("total").alias("total"))
    h = F.crc32(c("conv_id").cast("string").cast("binary")) % most
    opened = convs.withColumns({"h": h, "base": c("conv_id") - c("conv_id") % shared_by}).join(heads, "base", "left")
    opened = materialise(opened.select("conv_id", "h", "total", F.slice(F.coalesce("opening", F.array()), F.lit(1), c("h").cast("int")).alias("opening")).withColumn("k", F.size("opening").cast("long")), "trie-openings")

    first = opened.select("conv_id", "h", "total", "k", F.explode("opening").alias("o")).select("conv_id", c("o.i").cast("long").alias("pos"), c("o.chars").alias("chars"), ((c("o.i") == c("k")) & (c("total") <= c("h"))).alias("last"), *_own(c("o.i").cast("long"), c("o.content")))
    upto = Window.partitionBy("conv_id").orderBy("pos")  # fewer than ``most`` rows
    first = materialise(first.select("conv_id", "pos", "chars", "last", *[f"own_{s}" for s in SUMS], *[F.sum(f"own_{s}").over(upto).alias(s) for s in SUMS]), "trie-first")
    at_head = first.groupBy("conv_id").agg(*[F.sum(f"own_{s}").alias(f"head_{s}") for s in SUMS])

    told = parts.join(opened.select("conv_id", "h", "k"), "conv_id").join(at_head, "conv_id", "left").select("block", "conv_id", "had_n", "total", "h", "k", *[F.coalesce(f"head_{s}", F.lit(0)).alias(f"head_{s}") for s in SUMS])
    rest = turns.join(told, ["block", "conv_id"]).withColumn("i", place).where(c("i") > c("h")).withColumn("pos", c("i") - c("h") + c("k"))
    rest = rest.select("block", "conv_id", "pos", "chars", (c("i") == c("total")).alias("last"), *[f"head_{s}" for s in SUMS], *_own(c("pos"), c("content")))
    upto = Window.partitionBy("block", "conv_id").orderBy("pos")
    rest = materialise(rest.select("block", "conv_id", "pos", "chars", "last", *[f"own_{s}" for s in SUMS], *[(F.sum(f"own_{s}").over(upto) + c(f"head_{s}")).alias(s) for s in SUMS]), "trie-rest")
    crossing = parts.groupBy("conv_id").agg(F.count("*").alias("blocks")).where("blocks > 1").select("conv_id")
    crossed = rest.join(F.broadcast(crossing), "conv_id").groupBy("block", "conv_id").agg(*[F.sum(f"own_{s}").alias(s) for s in SUMS])
    had = F.broadcast(_carried(crossed, SUMS))
    rest = rest.join(had, ["block", "conv_id"], "left").select("conv_id", "pos", "chars", "last", *[f"own_{s}" for s in SUMS], *[(c(s) + F.coalesce(f"had_{s}", F.lit(0))).alias(s) for s in SUMS])
    return first.unionByName(rest), opened.select("conv_id", ((c("k") == 0) & (c("total") <= c("h"))).alias("turnless"))


def _sized(turns: DataFrame) -> DataFrame:
    """For each (block, conv_id): the conversation's turns in earlier blocks, and in all."""
    parts = turns.groupBy("block", "conv_id").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("conv_id")
    return materialise(_carried(parts, ("n",)).join(parts, ["block", "conv_id"]).select("block", "conv_id", "had_n", F.sum("n").over(whole).alias("total")), "trie-parts")


def _own(pos: Column, content: Column) -> list[Column]:
    """128 bits of a position and a content as four numbers, whose sums do not overflow."""
    two = [F.xxhash64(F.lit(seed), pos, content) for seed in (1, 2)]
    return [x.alias(f"own_{s}") for s, x in zip(SUMS, [y for v in two for y in (F.shiftrightunsigned(v, 32), v.bitwiseAND(F.lit(0xFFFFFFFF)))], strict=True)]


def _named(depth: Column, sums: list[Column], as_: tuple[str, str] = NODE[:2]) -> list[Column]:
    """128 bits of a prefix."""
    return [F.xxhash64(F.lit(seed), depth, *sums).alias(a) for seed, a in zip((1, 2), as_, strict=True)]


def members_sha256(ends: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each node at which conversations end: ends_sha256 of their ids, ascending, joined by commas."""
    ranges = max(1, math.ceil(ends.count() / block_rows))
    dealt = ends.repartitionByRange(ranges, "conv_id").withColumn("part", F.spark_partition_id())
    chunks = dealt.groupBy(*NODE, "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*now, digest.hexdigest()), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], [*NODE, "ends_sha256"])

        for b in batches:
            for *node, ids in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if node != now:
                    if now:
                        yield row()
                    now, digest = node, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        if now:
            yield row()

    several = chunks.groupBy(*NODE).agg(F.count("*").alias("n"), F.first("ids").alias("only"))
    alone = several.where("n = 1").select(*NODE, F.sha2("only", 256).alias("ends_sha256"))
    streamed = chunks.join(several.where("n > 1").select(*NODE), [*NODE]).repartition(*NODE).sortWithinPartitions(*NODE, "part").select(*NODE, "ids")
    return alone.unionByName(streamed.mapInArrow(run, "g1 long, g2 long, depth long, ends_sha256 string"))


def nodes_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Written nodes: NODE, conv_id, n_convs, chars, parent (p1, p2), ends_sha256."""
    c = F.col
    sums, less = [c(s) for s in SUMS], [c(s) - c(f"own_{s}") for s in SUMS]
    seen = turns.select("conv_id", c("pos").alias("depth"), "chars", "last", *_named(c("pos"), sums), *_named(c("pos") - 1, less, ("p1", "p2")))
    seen = materialise(seen, "trie-members")
    nodes = seen.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    zero = F.lit(0).cast("long")
    root = _named(zero, [zero] * len(SUMS))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(*root, zero.alias("depth"), "conv_id", "n_convs", zero.alias("chars"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    ends = seen.where("last").select(*NODE, "conv_id").unionByName(convs.where("turnless").select(*root, zero.alias("depth"), "conv_id"))
    empty = hashlib.sha256(b"").hexdigest()
    every = nodes.unionByName(top).join(members_sha256(materialise(ends, "trie-ends")), [*NODE], "left")
    return materialise(every.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty))), "trie-nodes")


def tour(nodes: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The arcs of the Euler tour for ``listrank``: id, sub (2 * depth into a node, 2 * depth + 1 out of it), successor, weights."""
    c = F.col
    order = ("parent_conv_id", "depth", "conv_id")
    rows = in_blocks(nodes.select(*order, "n_convs", "chars", "first_child"), "trie-siblings", *order, block_rows=block_rows)
    inside = Window.partitionBy("block").orderBy(*order)
    # One row for each block.
    first = rows.groupBy("block").agg(F.min(F.struct(*order)).alias("head")).select("block", F.lead("head").over(Window.orderBy("block")).alias("next_head"))
    rows = rows.withColumn("follows", F.lead(F.struct(*order)).over(inside)).join(F.broadcast(first), "block").withColumn("follows", F.coalesce("follows", "next_head"))
    sibling = F.when((c("follows.parent_conv_id") == c("parent_conv_id")) & (c("follows.depth") == c("depth")), c("follows.conv_id"))
    rows = rows.withColumn("sibling", sibling)
    into, out = c("depth") * 2, c("depth") * 2 + 1
    zero = F.lit(0).cast("long")
    leaf = c("first_child").isNull()
    enter = F.struct(into.alias("sub"), F.coalesce("first_child", "conv_id").alias("to_id"), F.when(leaf, out).otherwise(into + 2).alias("to_sub"), leaf.cast("long").alias("leaves"), ((c("n_convs") - 1) * c("chars")).alias("saved"))
    leave = F.struct(out.alias("sub"), F.when(c("sibling").isNotNull(), c("sibling")).otherwise(c("parent_conv_id")).alias("to_id"), F.when(c("sibling").isNotNull(), into).when(c("depth") > 0, out - 2).alias("to_sub"), zero.alias("leaves"), zero.alias("saved"))
    return rows.select(c("conv_id").alias("id"), F.explode(F.array(enter, leave)).alias("arc")).select("id", "arc.sub", "arc.to_id", "arc.to_sub", F.lit(1).cast("long").alias("arcs"), "arc.leaves", "arc.saved")


def trie(turns: DataFrame, convs: DataFrame, block_rows: int = BLOCK_ROWS, block_items: int = listrank.BLOCK_ITEMS) -> DataFrame:
    """A row for each node, from ``share_openings``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and enter and leave, the places of its arcs in the tour."""
    c = F.col
    nodes = nodes_of(turns, convs)
    kids = nodes.where("depth > 0").groupBy("p1", "p2", (c("depth") - 1).alias("depth")).agg(F.count("*").alias("n"), F.min("conv_id").alias("first_child"))
    kids = kids.select(c("p1").alias("g1"), c("p2").alias("g2"), "depth", "n", "first_child")
    nodes = materialise(nodes.join(kids, [*NODE], "left"), "trie-kids")
    parents = nodes.where("n > 0").select(c("g1").alias("p1"), c("g2").alias("p2"), c("conv_id").alias("parent_conv_id"), "n")
    shape = nodes.select("conv_id", "depth", "n_convs", "chars", "p1", "p2", "first_child", c("n").alias("kids"), "ends_sha256")
    below = lookup(shape.where("depth > 0"), parents, ["p1", "p2"], nodes.count()).drop("n")
    nodes = materialise(below.unionByName(shape.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))), "trie-shape")
    at = listrank.rank(tour(nodes, block_rows), ["arcs", "leaves", "saved"], block_items)
    held = at.groupBy(c("id").alias("conv_id"), F.floor(c("sub") / 2).alias("depth")).agg(F.min("arcs").alias("enter"), F.max("arcs").alias("leave"), (F.max("leaves") - F.min("leaves")).alias("n_leaves"), (F.max("saved") - F.min("saved")).alias("saved_tokens"))
    return nodes.join(held, ["conv_id", "depth"]).select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("kids", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", "ends_sha256", "enter", "leave")


def conversation_trie(conversations: DataFrame, shared_by: int = SHARED_BY, most: int = MOST_SHARED, block_rows: int = BLOCK_ROWS, block_items: int = listrank.BLOCK_ITEMS) -> DataFrame:
    """``trie`` of a table of turns (conv_id, turn, role, text), openings shared first."""
    small_batches(conversations.sparkSession)
    return trie(*share_openings(turn_rows(conversations, block_rows), shared_by, most), block_rows, block_items)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all ``conversations``, rebuilt with shared openings."""
    return conversation_trie(table(spark, sf_dir, "conversations")).drop("enter", "leave")


ORACLE = """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT conv_id, xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || flatten([[CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t) d),
parts AS (SELECT c.conv_id, 0 AS part, i, role, text FROM crc c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND i <= h UNION ALL SELECT conv_id, 1, i, role, text FROM t JOIN crc USING (conv_id) WHERE i > h),
rebuilt AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS depth FROM parts),
seqs AS (SELECT conv_id, depth, length(text) AS chars, md5(string_agg(concat(length(role), ':', role, length(text), ':', text), '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth)) AS prefix FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM crc),
named AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, prefix) AS node FROM seqs),
nodes AS (SELECT node, depth, count(*) AS n_convs, max(chars) AS chars FROM named GROUP BY node, depth),
linked AS (SELECT n.*, p.node AS parent FROM nodes n LEFT JOIN named p ON p.conv_id = n.node AND p.depth = n.depth - 1),
kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n FROM linked WHERE parent IS NOT NULL GROUP BY 1, 2),
owns AS (SELECT l.*, coalesce(k.n, 0) AS n_children FROM linked l LEFT JOIN kids k USING (node, depth)),
below AS (SELECT a.node, a.depth, count(*) FILTER (WHERE o.n_children = 0) AS n_leaves, sum((o.n_convs - 1) * o.chars) AS saved FROM owns o JOIN named a ON a.conv_id = o.node AND a.depth <= o.depth GROUP BY 1, 2),
ends AS (SELECT node, depth, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS sha FROM named WHERE (conv_id, depth) IN (SELECT conv_id, max(depth) FROM seqs GROUP BY conv_id) GROUP BY 1, 2)
SELECT o.node AS conv_id, CAST(o.depth AS BIGINT) AS depth, o.parent AS parent_conv_id, CAST(o.n_convs AS BIGINT) AS n_convs, CAST(o.n_children AS BIGINT) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
  CAST(b.saved AS BIGINT) AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256 FROM owns o JOIN below b USING (node, depth) LEFT JOIN ends e USING (node, depth)"""
