"""The training-data operators against brute force, on the smallest given tables and on small fixtures with edge rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.test_registry import rows_of
from tidegate.llm import digests, language, licenses, packing, preferences, quality, queries, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"

#: Rows with nulls, empty and very long texts, ties and repeats.
EDGE = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "!!! ###", "en", "a", 7), (4, "one", "en", "a", 3), (5, "one two three four five six seven eight nine ten", "en", "a", 0), (6, "one two three four five six seven eight nine ten", "de", None, 0),
    (6, "one two three four five six seven eight nine ten", "de", None, 0), (7, "word " * 40000, "en", "a", 0), (8, "x" * 60000, "en", "a", 0), (9, "1" * 5000 + "@" + "." * 5000, None, "a", 0), (None, "a text without a key, long enough to have some words", "en", "a", 0), (10, "É ß \U0001f600  5 kg", "fr", "a", 0),
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):
    assert rows_of(queries.QUERIES[name](spark, SF).toPandas()) == rows_of(duck.execute(queries.ORACLES[name]).df())


def test_warc_edges(spark):
    big = "é" * 600
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", big + "!")], "page_id long, url string, html string")
    index = warc.write_bundles(warc.plan_records(pages), warc.scratch(spark, "t"), frame_bytes=500, bundle_bytes=900)
    got = {r["key"]: r for r in warc.read_bundles(index, frames_a_task=1).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    assert got[1]["payload_bytes"] == 1200 and got[1]["payload_digest"] == hashlib.sha1(big.encode()).hexdigest() and got[5]["payload_bytes"] == 0
    found = warc.fetch(index, spark.createDataFrame([("urn:page:6",), ("urn:page:1",), ("urn:page:99",)], "record_id string")).collect()
    assert sorted(r["record_id"] for r in found) == ["urn:page:1", "urn:page:6"]
    assert all(bytes(r["record"]).startswith(b"WARC/1.1\r\n") for r in found) and any((big + "!").encode() in bytes(r["record"]) for r in found)
    assert warc.read_bundles(warc.archive(pages.limit(0))).count() == 0
    # A missing key, keys that repeat, columns with other meanings.
    odd = spark.createDataFrame([(None, "u", big, "x"), (None, "u", None, "x"), (7, "u", big, "x"), (7, "u", big, "x"), (8, "u", "short", None)], "page_id long, url string, html string, digest string").withColumn("key", F.lit(1))
    seen = sorted(((r["key"], r["record_type"], r["refers_to"]) for r in warc.read_bundles(warc.archive(odd)).collect()), key=str)
    assert seen == sorted([(None, "revisit", 7), (None, "response", None), (7, "response", None), (7, "response", None), (8, "response", None)], key=str)


def test_warc_ranges_are_read_in_parallel(spark):
    index = spark.createDataFrame([(f"r{i}", "b", i, 0, 1) for i in range(40)], warc.INDEX)
    assert warc.read_bundles(index, frames_a_task=1).rdd.getNumPartitions() == 40


def test_warc_bundles_are_seekable(spark, tmp_path):
    writer = warc.BundleWriter(str(tmp_path), "b", frame_bytes=100, bundle_bytes=1 << 20)
    for i in range(10):
        writer.add(f"r{i}", warc.record_bytes(f"r{i}", "response", "u", b"p%d" % i, "d", 2, None))
    rows = writer.close()
    import zstandard

    data = open(rows[0][1], "rb").read()
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 10  # any Zstandard reader passes over the footer
    for name, bundle, frame, at, size in rows:
        ((_, plain),) = warc.read_frames(bundle, [frame])
        assert name.encode() in plain[at : at + size] and plain[at:].startswith(b"WARC/1.1")


def test_licenses(spark, edge):
    rows = spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0."), (2, "a CC BY cc by\nReleased under the MIT License."), (3, "all rights\nreserved"), (4, "General Public Licence"), (5, "permission is hereby granted")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(rows).collect()}
    assert got[1]["labels"] == "apache-2.0" and got[1]["base_labels"] == "" and got[1]["score"] == 1
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"], got[2]["labels"]) == (2, 1, 3, "cc-by,mit")
    assert (got[3]["n_base"], got[3]["base_labels"], got[3]["score"]) == (1, "reserved", 1)
    assert got[4]["labels"] == got[5]["labels"] == "" and got[4]["first_word"] is None
    # Notices that cross lines, with a word or two changed, within other text; scattered words are no notice.
    full = next(t for t, k in licenses.TEMPLATES if k == "bsd-3-clause")
    wrap = lambda t, n: "\n * ".join(t[i : i + n] for i in range(0, len(t), n)) if n else t
    other = " ".join(f"lorem{i}" for i in range(90))
    mit = " ".join(licenses.TEMPLATES[2][0].split()[:-9] + ["or", "its", "other", "uses"])
    gpl = "This program is free software: you can redistribute\n# it and/or modify it under the\n# terms of the GNU General\n# Public License"
    text = [(1, other + "\n" + full.replace(" ", "\n") + "\n" + other), (1, other), (2, other + " " + mit + " " + other), (3, gpl), (4, "released " + other + " under the " + other + " mit license"), (None, "Released\nunder the\nMIT License"), (None, other)]
    met = [(r["doc_id"], r["labels"]) for r in licenses.scan_licenses(spark.createDataFrame(text, "doc_id long, text string")).collect()]
    assert sorted(met, key=str) == sorted([(1, "bsd,bsd-3-clause"), (1, ""), (2, "mit"), (3, "gpl"), (4, ""), (None, "mit"), (None, "")], key=str)
    seen = licenses.scan_licenses(edge).collect()
    assert len(seen) == len(EDGE) and {r["n_words"] for r in seen if r["doc_id"] in (1, 2, 3)} == {0} and next(r["n_words"] for r in seen if r["doc_id"] == 7) == 40000


def test_set_join_is_exact(spark):
    rng = random.Random(3)
    vocab = licenses.vocabulary()
    rows = [(i, rng.sample(range(len(vocab)), rng.randint(1, 30))) for i in range(300)]
    number = {w: i for i, w in enumerate(vocab)}
    split = [licenses.words_of(t) for t, _ in licenses.TEMPLATES]
    sets, steps = [{number[w] for w in t} for t in split], [licenses.step_of(t) for t in split]
    rows = [(i, rng.choice(steps), t) for i, t in rows]
    rows += [(1000 + i, steps[i], rng.sample(sorted(s), licenses.needed(len(s), 0.7)) + rng.sample(range(len(vocab)), 2)) for i, s in enumerate(sets)]
    rows = [(i, n, sorted(set(t))) for i, n, t in rows]
    blocks = spark.createDataFrame(rows, "block long, step int, tokens array<int>")
    for t in (0.5, 0.7, 1.0):
        got = {(r["block"], r["template"], round(r["containment"], 6)) for r in licenses.join_templates(blocks, threshold=t).collect()}
        assert got == {(i, k, round(len(s & set(x)) / len(s), 6)) for i, n, x in rows for k, s in enumerate(sets) if n == steps[k] and len(s & set(x)) >= licenses.needed(len(s), t)}


def test_language(spark, docs, edge, none):
    model = language.fit(docs.where(~language.held_out()))
    got = language.predict(docs.where(language.held_out()), model, keep=("doc_id", "lang")).toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.95 and got["score"].between(0, 1).all()
    seen = {r["doc_id"]: r["lang_pred"] for r in language.predict(edge, model).collect()}
    assert seen[1] == seen[2] == seen[3] == seen[9] == "und" and seen[4] != "und" and len(seen) == 11
    assert language.fit(none) is None
    assert {r["lang_pred"] for r in language.predict(docs.limit(3), None).collect()} == {"und"}


def test_codes():
    for k in (2, 3, 4, 5, 8, 20):
        m = language.code_matrix(k).astype(int)
        apart = [(m[i] != m[j]).sum() for i in range(k) for j in range(i)]
        assert m.shape[0] == k and min(apart) >= (1 if k == 2 else 2) and (np.abs(m.sum(0)) < k).all()


def test_digests(spark, docs, texts, edge, none):
    got = {r["doc_id"]: r for r in digests.edited_digests(docs).collect()}
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        t, n = texts[d], texts[order[(i + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        own, other, after = (digests.digest(x.encode()) for x in (t, edited, n))
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), own.hex(), other.hex())
        assert r["near_edited"] == digests.likeness(own, other) and r["near_next"] == digests.likeness(own, after) and 0 <= r["near_next"] <= 1
    assert digests.edited_digests(edge).count() == len(EDGE) and digests.edited_digests(none).count() == 0
    assert digests.edited_digests(docs.where("doc_id = 1")).first()["near_next"] == 1
    runs = digests.neighbour_runs(docs, run_rows=7)  # many runs: neighbours across their borders
    assert runs.where("ahead = 1").count() == runs.select("run").distinct().count()
    assert digests.fingerprints(edge).count() == len(EDGE)


def test_digest_runs_of_any_keys(spark):
    """Keys far apart, negative, at the ends of their type, repeated and missing: every run stays small, neighbours are right."""
    rng = random.Random(5)
    keys = [*range(3000), 10**15, -9 * 10**18, 9 * 10**18, -(2**63), 2**63 - 1, *range(-2000, -1900), *[77] * 50, *[None] * 400]
    rows = [(k, f"text {i} " + "x" * rng.randint(0, 40)) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = [r["count"] for r in digests.neighbour_runs(df, run_rows=256).where("ahead = 0").groupBy("run").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 800 and len(sizes) > 8
    got = {(r["doc_id"], r["fingerprint"]): r["edited_sha256"] for r in digests.edited_digests(df).collect()}
    told = sorted(k for k in keys if k is not None and keys.count(k) == 1)
    text = dict(rows)
    for below, k in zip(told, told[1:]):
        if below + 1 < k and 77 in range(below, k):
            continue
        edited = text[k][: len(text[k]) - len(text[k]) // 2] + text[below][: len(text[k]) // 2]
        assert got[k, digests.digest(text[k].encode()).hex()] == hashlib.sha256(edited.encode()).hexdigest()


def test_preferences(spark):
    t = "pair_id long, turn long, role string, text string"
    chosen = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "good"), (2, 0, "user", "q"), (2, 1, "assistant", "a"), (3, 0, "user", None), (3, 0, "user", "x"), (4, 0, "user", "only")], t)
    rejected = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "bad"), (1, 2, "user", "?"), (2, 5, "user", "q"), (2, 9, "assistant", "a"), (3, 0, "user", ""), (3, 0, "user", "y")], t)
    got = {r["pair_id"]: r for r in preferences.format_preferences(chosen, rejected).collect()}
    assert sorted(got) == [1, 2, 3]
    one = got[1]
    assert (one["prefix_turns"], one["prompt"]) == (1, "<|user|>\nq<|end|>\n") and one["chosen"] == "<|assistant|>\ngood<|end|>\n"
    a, b = map(int, one["chosen_loss"].split(":"))
    assert one["chosen"][a:b] == "good<|end|>\n" and one["rejected_loss"].count(":") == 1 and one["differs"]
    assert (got[2]["chosen"], got[2]["differs"], got[2]["prefix_turns"]) == ("", False, 2) and got[3]["prefix_turns"] == 1
    assert preferences.format_preferences(chosen.limit(0), rejected).count() == 0


def test_packing_round_trip(spark, docs, texts, edge, none):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {d: np.array(exact.encode(t, add_special_tokens=False).ids + [0], np.uint32) for d, t in texts.items()}
    got = packing.pack_documents(docs).toPandas()
    for d, pieces in got.sort_values("start").groupby("doc_id"):
        assert list(pieces["start"]) == list(pieces["length"].cumsum() - pieces["length"]) and set(pieces["doc_tokens"]) == {len(ids[d])} and pieces["length"].sum() == len(ids[d])
        for p in pieces.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[d][p.start : p.start + p.length].astype("<u4").tobytes())
    assert set(got["doc_id"]) == set(texts)
    used, full = 0, collections.Counter()
    bears = {}
    for d, t in texts.items():
        line = t.split("\n")[0] if "\n" in t else ""
        spans = exact.encode(t, add_special_tokens=False).offsets
        bears[d] = np.array([not line or a >= len(line) for a, _ in spans] + [False])
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        n = s["length"].sum()
        assert list(s["offset"]) == list(s["length"].cumsum() - s["length"]) and n <= 1024 and len(s) <= packing.MOST_SEGMENTS
        used += n if n & (n - 1) == 0 else 1024
        loss = sum(int(bears[p.doc_id][p.start : p.start + p.length].sum()) for p in s.itertuples())
        assert loss <= packing.MOST_LOSS_TOKENS
        full.update([k for k, v in (("tokens", n == 1024), ("segments", len(s) == packing.MOST_SEGMENTS), ("loss", loss == packing.MOST_LOSS_TOKENS)) if v])
    assert all(full[k] > 0.02 * got["sequence_id"].nunique() for k in ("tokens", "segments", "loss"))  # each limit binds
    assert used <= 1.01 * got["length"].sum()
    assert packing.pack_documents(none).count() == 0
    seen = packing.pack_documents(edge)
    assert seen.agg(F.sum("length")).first()[0] > 10000 and seen.where("doc_id = 1").first()["doc_tokens"] == 1


@pytest.mark.parametrize("limits", [(64, 4, 64), (64, 100, 20), (32, 2, 8), (100, 3, 1)])
def test_vector_limits(limits):
    rng = random.Random(4)
    packer = packing.VectorPacker(*limits, buffer=50)
    out, docs = [], {}
    for d in range(300):
        n = rng.randint(1, 150)
        ids, mask = np.arange(n, dtype=np.uint32) + d * 1000, np.array([rng.random() < 0.5 for _ in range(n)])
        docs[d] = (ids, mask)
        out.extend(packer.add(d, ids, mask))
    out.extend(packer.finish())
    held, loss = collections.defaultdict(list), collections.Counter()
    pieces = collections.defaultdict(list)
    for d, start, ids, seq, offset in out:
        held[seq].append((offset, len(ids)))
        loss[seq] += int(docs[d][1][start : start + len(ids)].sum())
        pieces[d].append((start, list(ids)))
    for seq, parts in held.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= limits[0] and len(parts) <= limits[1] and loss[seq] <= limits[2]
    assert {d: [x for _, p in sorted(ps) for x in p] for d, ps in pieces.items()} == {d: list(ids) for d, (ids, _) in docs.items()}


def test_latent_lines():
    """The chance that all lines are good against enumeration; lines of bad documents that look good are labelled good."""
    rng = np.random.default_rng(6)
    for n in range(1, 7):
        e, moves = rng.normal(size=n), rng.normal(size=(2, 2))
        f, b = quality.pass_messages(e, quality.chains(np.array([0, n])), moves)
        score = {y: sum(e[i] * v for i, v in enumerate(y)) + sum(moves[p, q] for p, q in zip(y, y[1:])) for y in itertools.product((0, 1), repeat=n)}
        want = score[(1,) * n] - np.log(sum(np.exp(v) for v in score.values()))
        assert abs(quality.all_good(e, b, np.array([0, n]), moves)[0] - want) < 1e-9
    rows, label, truth = [], [], []
    for i in range(300):
        good = [1] * int(rng.integers(3, 9))
        if i % 2:
            at = int(rng.integers(0, len(good)))
            good[at : at + 3] = [0] * len(good[at : at + 3])
        rows.append("\n".join(" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 12)) + "." if g else " ".join(rng.choice(["$$$", "###", "A!!", "B!!"], 12)) for g in good))
        label.append(1 - i % 2)
        truth += good
    x, size, begin = quality.line_features(pa.array(rows))
    field = quality.fit_field(x, size, begin, np.array(label))
    assert np.mean((quality.line_marginals(field, x, begin) >= 0.5) == np.array(truth)) > 0.98


def test_quality(spark, edge, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    field = quality.fit(docs, labels.where(~quality.held_out()))
    got = quality.score_quality(docs, field).join(labels, "doc_id").where(quality.held_out()).toPandas()
    good, bad = got[got["quality"] == 1]["score"].to_numpy(), got[got["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    seen = quality.score_quality(edge, field).collect()
    assert len(seen) == len(EDGE) and all(0 <= r["score"] <= 1 for r in seen)
    assert quality.fit(none, labels) is None and quality.score_quality(edge, None).count() == len(EDGE)


def test_chain_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    e, moves = rng.normal(size=9), rng.normal(size=(2, 2))
    begin = np.array([0, 4, 4, 9])
    f, b = quality.pass_messages(e, quality.chains(begin), moves)
    for lo, hi in ((0, 4), (4, 9)):
        n, total, good = hi - lo, 0.0, np.zeros(hi - lo)
        for code in range(1 << n):
            y = [(code >> i) & 1 for i in range(n)]
            p = np.exp(sum(e[lo + i] * y[i] for i in range(n)) + sum(moves[y[i], y[i + 1]] for i in range(n - 1)))
            total += p
            good += p * np.array(y)
        assert np.allclose(quality.sigmoid(f + b)[lo:hi], good / total)


def test_line_features_edges():
    x, size, begin = quality.line_features(pa.array(["", "a\n\nb", "\n", None or "", "word " * 30]))
    assert list(np.diff(begin)) == [0, 2, 0, 0, 1] and list(size[:2]) == [1, 1] and np.isfinite(x).all()
    assert quality.line_features(pa.array([], pa.string()))[0].shape[0] == 0
