"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a run of consecutive words, whatever lines it crosses: for templates of up to n words, 2 * n words starting
at every n-th word (n a power of two), so that every run of as many words as the template has lies within one block.
A block meets a template if it holds at least the share ``threshold`` of the template's distinct words. Words are
ordered by how many blocks of the whole corpus hold them, rarest first. A block that meets a template of n words at
c = ceil(threshold * n) must hold one of its n - c + 1 rarest words (prefix filter), must hold c template words at all
(length filter), and from a shared word at place i of the template and j of the block at most n - i and m - j words
can still be shared (positional filter). What passes is compared in full.

One pass over the texts keeps, for each block that passes the length filter, the numbers of the words that occur in
any template of its length. The vocabulary, its frequencies and the templates are bounded by the template list, not by
the corpus.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import textarrays as ta
from tidegate.llm.base import materialise, small_batches, table

#: Phrases (as words) and the label that each gives.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices and license texts, and the label that each gives.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "mit",
    ),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "apache-2.0",
    ),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "bsd-3-clause",
    ),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "gpl-3.0-or-later",
    ),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mpl-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "unlicense",
    ),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
        "zlib",
    ),
    ("no part of this publication may be reproduced without the prior written permission of the publisher", "reserved"),
)
THRESHOLD = 0.9
#: The shortest blocks start at every so many words.
LEAST_STEP = 8

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCAN = "n_words long, n_base long, first_word long, last_word long, phrases array<int>, blocks array<struct<step:int,block:long,tokens:array<int>>>"


def words_of(text: str) -> list[str]:
    return re.findall(WORDS, text.lower())


def step_of(words: list[str]) -> int:
    """Words between the starts of the blocks that a template is compared with: a power of two, the template's length at least."""
    return max(LEAST_STEP, 1 << (len(words) - 1).bit_length())


def vocabulary(templates=TEMPLATES, phrases=PHRASES) -> list[str]:
    return sorted({w for text, _ in (*templates, *phrases) for w in words_of(text)})


def needed(size: int, threshold: float = THRESHOLD) -> int:
    """Words of a template of so many that a block must hold."""
    return math.ceil(threshold * size - 1e-9)


def scan_texts(docs: DataFrame, key: str, text: str, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One pass: key, word counts, places of the phrases, and the template words of each block that holds enough of them."""
    small_batches(docs.sparkSession)
    vocab = [w.encode() for w in vocabulary(templates, phrases)]
    number = {w: i for i, w in enumerate(vocab)}
    goals = [[number[w.encode()] for w in words_of(p)] for p, _ in phrases]
    kind = dict(docs.select(F.col(key).alias("key")).dtypes)["key"]
    steps: dict[int, tuple[np.ndarray, int]] = {}  # for each step which words count, and the fewest that a block must hold
    for t, _ in templates:
        own, step = words_of(t), step_of(words_of(t))
        wanted, least = steps.get(step, (np.zeros(len(vocab), bool), 1 << 30))
        wanted[[number[w.encode()] for w in own]] = True
        steps[step] = (wanted, min(least, needed(len(set(own)), threshold)))

    def blocks_of(word: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """Document, step, number and words of each block, a row for each word; ordered."""
        out = []
        for step, (wanted, least) in sorted(steps.items()):
            hit = np.flatnonzero((word >= 0) & wanted[word])
            if not len(hit):
                continue
            # A word is in the block that starts at or before its step, and in the one before that.
            at = place[hit] // step
            wide, many = int(at.max()) + 2, len(vocab)  # block -1 is dropped below
            code = np.unique(np.concatenate([((doc[hit] * wide + at + 1 - o) * many + word[hit]) for o in (0, 1)]))
            block = code // many
            code, block = code[block % wide > 0], block[block % wide > 0]
            new = np.flatnonzero(np.diff(block, prepend=-1))
            size = np.diff(np.append(new, len(block)))
            keep = np.repeat(size >= least, size)
            code, block = code[keep], block[keep]
            out.append(np.stack((block // wide, np.full(len(block), step), block % wide - 1, code % many)))
        found = np.concatenate(out, 1) if out else np.zeros((4, 0), np.int64)
        return tuple(found[:, np.argsort(found[0], kind="stable")])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = np.frombuffer(b" ".join(vocab), np.uint8)
        ends = np.cumsum([len(w) + 1 for w in vocab]) - 1
        hashes = ta.span_hashes(raw, ends - np.array([len(w) for w in vocab]), ends)
        order = np.argsort(hashes)
        lower = np.arange(256, dtype=np.uint8)
        lower[0x41:0x5B] += 32
        for batch in batches:
            keys, texts = batch.column(0), ta.column(batch, "text")
            for lo, hi in ta.chunks(texts):
                raw, off = ta.utf8(texts.slice(lo, hi - lo))
                raw = lower[raw]
                starts, stops, at = ta.words(raw, off)
                h = ta.span_hashes(raw, starts, stops)
                place = np.minimum(np.searchsorted(hashes[order], h), len(vocab) - 1)
                word = np.where(hashes[order][place] == h, order[place], -1)
                doc = np.repeat(np.arange(hi - lo), np.diff(at))
                found: list[list[tuple[int, int]]] = [[] for _ in range(hi - lo)]
                for k, goal in enumerate(goals):
                    same = word[: len(word) - len(goal) + 1] == goal[0] if len(word) >= len(goal) else np.zeros(0, bool)
                    for i in np.flatnonzero(same):
                        if doc[i] == doc[i + len(goal) - 1] and all(raw[starts[i + j] : stops[i + j]].tobytes() == vocab[w] for j, w in enumerate(goal)):
                            found[doc[i]].append((int(i - at[doc[i]]), k))
                owner, step, block, tokens = blocks_of(word, doc, np.arange(len(word)) - at[doc])
                new = np.ones(len(owner), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (step[1:] != step[:-1]) | (block[1:] != block[:-1])
                first = np.flatnonzero(new)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(tokens)), pa.int32()), pa.array(tokens, pa.int32()))
                cells = pa.StructArray.from_arrays([pa.array(step[first], pa.int32()), pa.array(block[first], pa.int64()), lists], ["step", "block", "tokens"])
                per_doc = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[first], np.arange(hi - lo + 1)), pa.int32()), cells)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(lo, hi - lo),
                        pa.array(np.diff(at), pa.int64()),
                        pa.array([len(x) for x in found], pa.int64()),
                        pa.array([min(x)[0] if x else None for x in found], pa.int64()),
                        pa.array([max(x)[0] if x else None for x in found], pa.int64()),
                        pa.array([sorted({k for _, k in x}) for x in found], pa.list_(pa.int32())),
                        per_doc,
                    ],
                    ["key", "n_words", "n_base", "first_word", "last_word", "phrases", "blocks"],
                )

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(scan, f"key {kind}, {SCAN}")


def join_templates(blocks: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES) -> DataFrame:
    """Every (block, template) that meets the threshold. ``blocks``: any columns, ``step`` and ``tokens`` (numbers of template words).

    Returns the block's columns with template, label, and containment.
    """
    spark = blocks.sparkSession
    vocab = vocabulary(templates, phrases)
    number = {w: i for i, w in enumerate(vocab)}
    # One row for each word of the templates at most: bounded by the template list.
    seen = {r["t"]: r["n"] for r in blocks.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    rank = {w: i for i, w in enumerate(sorted(range(len(vocab)), key=lambda w: (seen.get(w, 0), w)))}
    split = [words_of(text) for text, _ in templates]
    ordered = [sorted({rank[number[w]] for w in words}) for words in split]
    prefix = [(r, k, step_of(split[k]), i, len(t), needed(len(t), threshold)) for k, t in enumerate(ordered) for i, r in enumerate(t[: len(t) - needed(len(t), threshold) + 1])]
    index = F.broadcast(spark.createDataFrame(prefix, "rank int, template int, step int, place int, size int, need int"))
    full = F.broadcast(spark.createDataFrame([(k, t, templates[k][1]) for k, t in enumerate(ordered)], "template int, ranks array<int>, label string"))
    ranks = F.array(*[F.lit(rank[w]) for w in range(len(vocab))])
    kept = blocks.withColumn("own", F.array_sort(F.transform("tokens", lambda t: F.get(ranks, t)))).drop("tokens")
    names = [c for c in kept.columns if c not in ("own", "step")]
    near = kept.select("*", F.posexplode("own").alias("at", "rank")).join(index, ["step", "rank"]).where((F.col("size") - F.col("place") >= F.col("need")) & (F.size("own") - F.col("at") >= F.col("need")))
    near = near.join(full, "template").withColumn("shared", F.size(F.array_intersect("own", "ranks")))
    # A block may share several prefix words with a template; its first one stands for all.
    first = F.get(F.array_intersect("own", F.slice("ranks", 1, F.col("size") - F.col("need") + 1)), F.lit(0)) == F.col("rank")
    return near.where(first & (F.col("shared") >= F.col("need"))).select(*names, "template", "label", (F.col("shared") / F.col("size")).alias("containment"))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES) -> DataFrame:
    """A row for each document: word count, places of the phrases, labels of phrases and of matching blocks, score.

    score is the best containment of a template, or 1 where a phrase stands. A null or empty text has no words, no
    label and score 0. Rows with equal or null keys are separate documents.
    """
    # A number for each row, fixed by writing it, leads its matches back to it.
    seen = materialise(scan_texts(docs, key, text, templates, phrases, threshold).withColumn("row", F.monotonically_increasing_id()), "license-scan")
    blocks = seen.select("row", F.explode("blocks").alias("b")).select("row", "b.step", "b.tokens")
    met = join_templates(blocks, templates, threshold, phrases).groupBy("row").agg(F.collect_set("label").alias("met"), F.max("containment").alias("best"))
    names = F.array(*[F.lit(label) for _, label in phrases])
    base = F.array_sort(F.array_distinct(F.transform("phrases", lambda k: F.get(names, k))))
    none = F.array().cast("array<string>")
    return seen.join(met, "row", "left").select(
        F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word",
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("met", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license scan over every whole text of ``documents``."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def oracle() -> str:
    pattern = WORDS
    spot = [f"(w[i] = '{p.split()[0]}'" + "".join(f" AND w[i + {j}] = '{x}'" for j, x in enumerate(p.split()[1:], 1)) + ")" for p, _ in PHRASES]
    names = "[" + ", ".join("CASE WHEN len(list_filter(range(1, len(w) + 1), lambda i: " + s + f")) > 0 THEN '{label}' END" for s, (_, label) in zip(spot, PHRASES)) + "]"
    rows = ", ".join(f"({k}, '{label}', {step_of(words_of(t))}, {sorted(set(words_of(t)))}, {needed(len(set(words_of(t))))})" for k, (t, label) in enumerate(TEMPLATES))
    return f"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS w FROM low),
hits AS (SELECT doc_id, w, len(w) AS n, list_filter(range(1, len(w) + 1), lambda i: {" OR ".join(spot)}) AS h FROM words),
multi AS (SELECT doc_id, {" + ".join(f"len(list_filter(range(1, len(w) + 1), lambda i: {s}))" for s in spot)} AS n_base FROM words),
base AS (SELECT doc_id, list_sort(list_distinct(list_filter({names}, lambda x: x IS NOT NULL))) AS b FROM words),
templates(k, label, step, words, need) AS (VALUES {rows}),
terms AS (SELECT DISTINCT step, unnest(words) AS word FROM templates),
places AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS place FROM words),
held AS (SELECT DISTINCT doc_id, step, place // step - o AS block, word FROM places JOIN terms USING (word), (VALUES (0), (1)) AS one(o)),
blocks AS (SELECT doc_id, step, block, list(word) AS s FROM held WHERE block >= 0 GROUP BY ALL),
met AS (SELECT doc_id, label, len(list_intersect(s, words)) AS shared, len(words) AS size FROM blocks JOIN templates USING (step) WHERE len(list_intersect(s, words)) >= need),
best AS (SELECT doc_id, list(DISTINCT label) AS met, max(CAST(shared AS DOUBLE) / size) AS best FROM met GROUP BY doc_id)
SELECT h.doc_id, CAST(n AS BIGINT) AS n_words, CAST(n_base AS BIGINT) AS n_base, CAST(list_min(h) - 1 AS BIGINT) AS first_word, CAST(list_max(h) - 1 AS BIGINT) AS last_word,
  array_to_string(b, ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(b, coalesce(met, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM hits h JOIN multi USING (doc_id) JOIN base USING (doc_id) LEFT JOIN best USING (doc_id)
"""
