"""Ranking of linked lists too long for one task, with sums along them.

A list is a table of items (two numbers name an item), each with its successor and weights. Ranking is by contraction:
items are dealt to blocks of bounded size by ranges of their names, each task joins the runs of items whose links stay
in its block into one segment (weights summed) and notes each item's head and the sums before it; the segments are a
shorter list, ranked in the same way with wider ranges, and sums are handed down again level by level. Where names
follow the list, few links leave a block and two or three levels do. Where a level joins too little, a round of
splicing removes a quarter of the segments whatever the names are: each whose own coin is tails and whose
predecessor's is heads joins its predecessor. So the work in all is a multiple of the list, not of its length times
the rounds, and no task ever holds more than a block.

Every level is written to the shared folder: a lost executor repeats tasks of one level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.base import materialise, small_batches

#: Items of a block.
BLOCK_ITEMS = 65_536
#: Segments whose sums are broadcast to their items (a few MB), by their counted number.
MOST_BROADCAST = 50_000
#: A level that leaves more than this share of its items is followed by splicing.
LEAST_GAIN = 0.7

ITEM = ("id", "sub", "to_id", "to_sub")


def runs(ids: np.ndarray, subs: np.ndarray, to_ids: np.ndarray, to_subs: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of items in one place (``ends`` marks those without successor): the index of each item's head and last item, the
    sums before it from its head (a column for each weight), and the sums of its whole run."""
    n = len(ids)
    names, at = np.unique(ids, return_inverse=True)
    span = int(subs.max()) + 1
    code = at * span + subs
    place = np.minimum(np.searchsorted(names, to_ids), len(names) - 1)
    near = ~ends & (names[place] == to_ids) & (to_subs < span)
    order = np.argsort(code)
    target = place * span + to_subs
    hit = np.minimum(np.searchsorted(code[order], target), n - 1)
    near &= code[order][hit] == target
    after = np.where(near, order[hit], -1)
    before = np.full(n, -1, np.int64)
    before[after[near]] = np.flatnonzero(near)
    linked = before >= 0
    head = np.where(linked, before, np.arange(n))
    sums = np.where(linked[:, None], weights[before], 0)
    jump = before.copy()
    while (live := jump >= 0).any():
        j = jump[live]
        sums[live] += sums[j]
        head[live] = head[j]
        jump[live] = jump[j]
    last = np.zeros(n, np.int64)
    tails = np.flatnonzero(after < 0)
    last[head[tails]] = tails
    total = np.zeros_like(sums)
    total[head[tails]] = sums[tails] + weights[tails]
    return head, last[head], sums, total[head]


def _contract(items: DataFrame, blocks: int, weights: list[str]) -> DataFrame:
    """Each item with its head and the sums before it; a head also has its segment's successor and sums."""
    kinds = dict(items.dtypes)
    made = [*ITEM[:2], "head_id", "head_sub", *[f"before_{w}" for w in weights], "is_head", "to_id", "to_sub", *weights]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([*batches]) if (batches := [*batches]) else None
        if rows is None or not rows.num_rows:
            return
        ids, subs = (rows.column(c).to_numpy() for c in ITEM[:2])
        ends = np.asarray(rows.column("to_id").is_null())
        to_ids, to_subs = (rows.column(c).fill_null(0).to_numpy() for c in ITEM[2:])
        w = np.stack([rows.column(x).to_numpy() for x in weights], axis=1)
        head, last, sums, total = runs(ids, subs, to_ids, to_subs, ends, w)
        first = head == np.arange(len(ids))
        only = lambda values, ok: pa.array(values, mask=~ok)
        leads = first & ~ends[last]
        out = [ids, subs, ids[head], subs[head], *sums.T, first]
        columns = [pa.array(np.ascontiguousarray(x)) for x in out] + [only(to_ids[last], leads), only(to_subs[last], leads)] + [only(np.ascontiguousarray(x), first) for x in total.T]
        yield from pa.table(columns, names=made).to_batches(max_chunksize=8192)

    schema = ", ".join(f"{c} {'boolean' if c == 'is_head' else kinds.get(c, 'bigint')}" for c in made)
    return items.select(*ITEM, *weights).repartitionByRange(blocks, *ITEM[:2]).mapInArrow(run, schema)


def _splice(items: DataFrame, weights: list[str], level: int) -> DataFrame:
    """As ``_contract``, by coins: an item of coin 0 after one of coin 1 joins it."""
    tossed = materialise(items.withColumn("coin", F.xxhash64(F.lit(level), "id", "sub").bitwiseAND(F.lit(1))), "rank-coins")
    takers = tossed.where("coin = 1").select(F.col("id").alias("head_id"), F.col("sub").alias("head_sub"), F.col("to_id").alias("id"), F.col("to_sub").alias("sub"), *[F.col(w).alias(f"before_{w}") for w in weights])
    taken = materialise(tossed.where("coin = 0").join(takers, ["id", "sub"]), "rank-taken")
    none = [F.lit(None).cast("long").alias(c) for c in ("to_id", "to_sub", *weights)]
    gone = taken.select("id", "sub", "head_id", "head_sub", *[f"before_{w}" for w in weights], F.lit(False).alias("is_head"), *none)
    gained = taken.select(F.col("head_id").alias("id"), F.col("head_sub").alias("sub"), F.lit(True).alias("joined"), F.col("to_id").alias("next_id"), F.col("to_sub").alias("next_sub"), *[F.col(w).alias(f"more_{w}") for w in weights])
    stays = tossed.join(taken.select("id", "sub"), ["id", "sub"], "left_anti").join(gained, ["id", "sub"], "left")
    moved = lambda a, b: F.when(F.col("joined"), F.col(b)).otherwise(F.col(a)).alias(a)
    kept = stays.select("id", "sub", F.col("id").alias("head_id"), F.col("sub").alias("head_sub"), *[F.lit(0).cast("long").alias(f"before_{w}") for w in weights], F.lit(True).alias("is_head"), moved("to_id", "next_id"), moved("to_sub", "next_sub"), *[(F.col(w) + F.coalesce(F.col(f"more_{w}"), F.lit(0))).alias(w) for w in weights])
    return kept.unionByName(gone)


def rank(items: DataFrame, weights: list[str], block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``id``, ``sub`` and, for each weight, the sum over the items before this one in its list.

    ``items``: id, sub, to_id, to_sub (both null at a list's end) and weights, all long. A list must not be a cycle.
    An empty table gives none.
    """
    small_batches(items.sparkSession)
    heads = materialise(items.select(*ITEM, *weights), "rank-items")
    number, steps, level = heads.count(), [], 0
    while number > 0:
        blocks = math.ceil(number / block_items)
        step = materialise(_contract(heads, blocks, weights), f"rank-{level}")
        heads = step.where("is_head").select(*ITEM, *weights)
        left = heads.count()
        steps.append((step, left))
        level += 1
        if blocks == 1:
            break
        if left > LEAST_GAIN * number:
            step = materialise(_splice(heads, weights, level), f"rank-{level}")
            heads = step.where("is_head").select(*ITEM, *weights)
            left = heads.count()
            steps.append((step, left))
            level += 1
        number = left
    found = None
    for i, (step, _) in reversed([*enumerate(steps)]):
        own = [F.col(f"before_{w}").alias(w) for w in weights]
        if found is None:
            found = step.select("id", "sub", *own)
        else:
            above = found.select(F.col("id").alias("head_id"), F.col("sub").alias("head_sub"), *[F.col(w).alias(f"at_{w}") for w in weights])
            above = F.broadcast(above) if steps[i][1] <= MOST_BROADCAST else above
            found = step.join(above, ["head_id", "head_sub"]).select("id", "sub", *[(F.col(f"before_{w}") + F.col(f"at_{w}")).alias(w) for w in weights])
        if i:
            found = materialise(found, f"rank-at-{i}")
    return items.select("id", "sub", *weights).limit(0) if found is None else found
