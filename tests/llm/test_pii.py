"""Personal data against plain regular expressions, slow versions of what is fitted, and texts with very many spans."""

import hashlib
import itertools
import math
import random
import re

import numpy as np

from tests.llm.test_operators import EDGE
from tidegate.llm import pii

BASE = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda v: True), "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda v: all(int(x) <= 255 for x in v.split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda v: 12 <= len(re.sub("[^0-9]", "", v)) <= 19 and luhn(re.sub("[^0-9]", "", v))), "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15),
}


def luhn(d):
    return sum(int(x) if i % 2 == 0 else (int(x) * 2 - 9 if int(x) > 4 else int(x) * 2) for i, x in enumerate(reversed(d))) % 10 == 0


def base_of(text):
    found = sorted((m.start(), i, m.end(), k) for i, (k, (p, ok)) in enumerate(BASE.items()) for m in p.finditer(text) if ok(m.group(0)))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)


def test_pii(spark, docs, texts, edge, none):
    rng = random.Random(5)
    pieces = ["a@b.com", "x.y+z@mail-1.example.co.uk_q@r.st", "1.2.3.4.5.6.7.8", "001.2.3.256", "4111 1111 1111 1111", "4111111111111111 ", "+1 (621) 555-4974", "+49-30-1234567", " ", "@", ".", "é", "12", "- ", "4", "+", "😀", "a_b%c", "\n"]
    made = [(1000 + i, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))) for i in range(300)]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    every = texts | dict(made)
    for r in pii.scan_pii(rows).collect():
        want = base_of(every[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (r["doc_id"], want, r["spans"])
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in BASE] == [want.count(k + ":") for k in BASE]
    assert pii.scan_pii(edge).count() == len(EDGE) and pii.scan_pii(none).count() == 0


def test_pii_adds_and_redacts(spark):
    rows = spark.createDataFrame([(1, 'a token = "' + "ab12" * 10 + '" and mail me@x.org now'), (2, "contact john.doe [at] mail [dot] com please"), (3, "nothing at all"), (4, None), (5, "order 1234567890123456 and page 12")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(rows).collect()}
    assert got[1] == 'a token = "<SECRET>" and mail <EMAIL> now' and got[2] == "contact <EMAIL> please" and got[3] == "nothing at all" and got[4] is None and got[5].startswith("order 1234567890123456")


def test_secrets_are_found(spark):
    """The planted secrets: all are among the spans, and clean documents have none of their kind."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    secret = re.compile(r'token = "([0-9a-f]{32,64})"')
    got = {r["doc_id"]: set(r["spans"].split(",")) for r in pii.scan_pii(docs).collect()}
    want = {d: {f"secret:{m.start(1)}:{m.end(1)}" for m in secret.finditer(t)} for d, t in texts.items()}
    planted = sum(map(len, want.values()))
    caught = sum(len(want[d] & got[d]) for d in want)
    assert planted and caught >= 0.95 * planted
    assert not any("secret:" in s for d in texts if not re.search("[0-9a-f]{32}", texts[d]) for s in got[d])


def test_many_spans_of_one_text(spark):
    """Work grows with the number of spans, not its square; places are right beyond the plane of 16 bits."""
    n = 20000
    text = "😀".join(f" user{i}@mail{i % 97}.example.com" for i in range(n))
    docs = spark.createDataFrame([(1, text, "kept")], "doc_id long, text string, pii_base string")
    row = pii.scan_pii(docs).first()
    at = [m.span() for m in BASE["email"][0].finditer(text)]
    assert row["n_email"] == n and row["spans"] == ",".join(f"email:{a}:{b}" for a, b in at)
    clean = pii.redact(docs).first()
    assert clean["text"] == "😀".join([" <EMAIL>"] * n) and clean["pii_base"] == "kept"


def test_running(spark):
    rng = random.Random(1)
    rows = [[rng.randint(0, 9) for _ in range(n)] for n in (0, 1, 2, 63, 64, 65, 128, 500)]
    df = spark.createDataFrame([(v,) for v in rows], "v array<int>")
    for v, total, most in df.select("v", pii.running(pii.F.col("v"), "sum"), pii.running(pii.F.col("v"), "max")).collect():
        assert total == [sum(v[:i]) for i in range(len(v))] and most == [max([0, *v[:i]]) for i in range(len(v))]


def test_overlaps(spark):
    """Candidates beside many base spans: those that overlap one go, however far apart their starts are in the list."""
    rng = random.Random(2)
    cases = []
    for _ in range(40):
        base = sorted((s, s + rng.randint(1, 30)) for s in (rng.randint(0, 300) for _ in range(rng.randint(0, 12))))
        extra = sorted((s, s + rng.randint(1, 12)) for s in rng.sample(range(300), rng.randint(0, 9)))
        cases.append((base, extra))
    cell = lambda spans: [(s, 0, e, "x") for s, e in spans]
    t = "array<struct<start:int,rank:int,end:int,kind:string>>"
    df = spark.createDataFrame([(i, cell(b), cell(e)) for i, (b, e) in enumerate(cases)], f"i int, base {t}, extra {t}")
    for r in df.select("i", pii.without_overlap(pii.F.col("extra"), pii.F.col("base")).alias("kept")).collect():
        base, extra = cases[r["i"]]
        assert [(s["start"], s["end"]) for s in r["kept"]] == [(s, e) for s, e in extra if not any(b < e and s < f for b, f in base)]


def made_patterns(rng, right, share, n=4000):
    """Spans with votes of labelers that are right as often as told, and their truth."""
    spans = []
    for _ in range(n):
        kind = rng.choice(pii.KINDS[:3])
        real = rng.random() < share
        vote = tuple(0 if rng.random() < 0.3 else (1 if real == (rng.random() < r) else -1) for r in right)
        spans.append((kind, vote, real))
    counts = {}
    for kind, vote, _ in spans:
        counts[False, kind, vote] = counts.get((False, kind, vote), 0) + 1
    return spans, sorted((*k, n) for k, n in counts.items())


def test_estimates_against_a_slow_version():
    """Expectation-maximisation over single spans with plain products of chances, and against the truth that made the votes."""
    rng = random.Random(3)
    true = (0.95, 0.9, 0.85, 0.8, 0.75, 0.7)
    spans, patterns = made_patterns(rng, true, 0.4)
    right, share, real = pii.estimate(patterns, rounds=15)
    r, q = [pii.START_RIGHT] * 6, dict.fromkeys(pii.KINDS, pii.START_SHARE)
    for _ in range(15):
        p = []
        for kind, vote, _ in spans:
            yes = math.prod(x if v > 0 else 1 - x for x, v in zip(r, vote) if v) * q[kind]
            no = math.prod(1 - x if v > 0 else x for x, v in zip(r, vote) if v) * (1 - q[kind])
            p.append(yes / (yes + no))
        for i in range(6):
            cast = [a if s[1][i] > 0 else 1 - a for a, s in zip(p, spans) if s[1][i]]
            r[i] = min(0.99, max(0.55, (pii.PULL * pii.START_RIGHT + sum(cast)) / (pii.PULL + len(cast))))
        for kind in pii.KINDS:
            mine = [a for a, s in zip(p, spans) if s[0] == kind]
            q[kind] = min(0.9, max(0.1, (pii.PULL * pii.START_SHARE + sum(mine)) / (pii.PULL + len(mine))))
    assert np.allclose([right[x] for x in pii.LABELERS], r) and all(abs(share[k] - q[k]) < 1e-9 for k in pii.KINDS)
    assert np.allclose(list(right.values()), true, atol=0.05)
    by = {(k, v): x for (_, k, v, _), x in zip(patterns, real)}
    assert np.mean([(by[k, v] > 0.5) == t for k, v, t in spans]) > 0.9
    # Known spans are real whatever the votes say.
    assert pii.estimate([(True, "ip", (-1,) * 6, 5)])[2] == [1.0]


def test_classifier_against_a_slow_version():
    """Gradient ascent reaches what Newton steps on every single span reach, and judges patterns as the estimates do."""
    _, patterns = made_patterns(random.Random(4), (0.95, 0.9, 0.85, 0.8, 0.75, 0.7), 0.4)
    real = pii.estimate(patterns)[2]
    weights = pii.train(patterns, real, rounds=20000)
    names = list(weights)
    place = {n: i for i, n in enumerate(names)}
    x = np.array([[float(i in {0, place[k], *(place[f"{a}:{b}"] for a, b in zip(pii.LABELERS, v) if b)}) for i in range(len(names))] for _, k, v, _ in patterns])
    n = np.array([c for *_, c in patterns], float)
    w = np.zeros(len(names))
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (n * p * (1 - p) / n.sum())[:, None]).T @ x + 1e-4 * np.eye(len(w)), x.T @ ((np.array(real) - p) * n / n.sum()) - 1e-4 * w)
    mine = 1 / (1 + np.exp(-x @ np.array([weights[k] for k in names])))
    assert np.abs(mine - 1 / (1 + np.exp(-x @ w))).max() < 0.02
    assert np.average((mine > 0.5) == (np.array(real) > 0.5), weights=n) > 0.97


def test_written_addresses_need_their_mark():
    for a, b in itertools.product("[(", "])"):
        assert re.search(pii.WRITTEN_AT, f"me {a}at{b} x {a}dot{b} org")
