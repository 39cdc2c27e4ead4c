"""Personal data by weak supervision.

Base spans come from fixed patterns with checks. Further candidates (loose numbers, obfuscated addresses, hexadecimal
secrets, account numbers) are judged by labelers that vote for, against or not at all: patterns, gazetteers and the
words before a span. Expectation-maximisation over the counts of vote patterns in the whole corpus estimates how
reliable each labeler is, with the base spans as known positives; the resulting probabilities train the final
classifier of spans, a logistic regression over votes and kinds. Base spans always stay; a candidate stays where the
classifier gives it one half or more, its check sum (if its kind has one) is right, and it overlaps no base span.

DataFrame functions only. One pass over the texts cuts each at the matches of the patterns and writes the places of
the spans with the labelers' votes; fitting and deciding read that small table. Work and memory are in proportion to a
text's length and its spans. Vote patterns are bounded by the labelers (three votes each), so what is fitted does not
grow with the corpus; applying the classifier needs no shuffle and no join.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm.base import let, materialise, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "ssn", "iban")

#: The base patterns. Starts are limited to where a leftmost match can begin and quantifiers are possessive where no
#: shorter match is possible, so that long runs of characters cost linear time; the matches are the same. What stands
#: before a match is looked at after its first character, which most characters of a text fail at once.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9]{2})(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates that the labelers judge; the shape of a match tells its kind.
SHAPES = {
    "secret": r"[0-9a-f](?<![A-Za-z0-9][0-9a-f])[0-9a-f]{31,63}+(?![A-Za-z0-9])",
    "written": r"[A-Za-z0-9](?<![A-Za-z0-9._%+-].)[A-Za-z0-9._%+-]{0,63}+\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?[A-Za-z0-9-]++)++",
    "ssn": r"[0-9]{3}(?<![0-9-][0-9]{3})-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"[A-Z]{2}[0-9]{2}(?<![A-Za-z0-9][A-Z]{2}[0-9]{2})(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])",
    "phone": r"[0-9(](?<![0-9+].)(?<![0-9][\x20.-].)(?:(?<=\()[0-9]{3}|(?<=[0-9])[0-9]{2})\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\x20.-]?[0-9])",
    "card": PATTERNS["card"],
}
LOOSE = "|".join(SHAPES.values())
#: An address in words needs this; other texts are spared its pattern.
WRITTEN_AT = r"[\[(]\x20?at\x20?[\])]"
LOOSE_PLAIN = "|".join(p for k, p in SHAPES.items() if k != "written")

#: Gazetteers and context words.
TOP_DOMAINS = "com|org|net|edu|gov|io|co|info|biz|de|fr|es|it|uk|nl|eu|ch|at|us|ca|au|jp|cn|in|br|ru"
CALLING_CODES = r"\+(1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-8]|35[0-9]|37[0-9]|38[0-9]|42[0-3])"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65|35"
CONTEXT = {
    "email": "e-?mail|mail|contact|write|reach", "ip": "ip|host|server|address|login|from", "card": "card|visa|mastercard|credit|debit|payment|account",
    "phone": "phone|tel|telephone|call|mobile|cell|fax|contact", "secret": "token|secret|password|passwd|key|apikey|auth", "ssn": "ssn|social|security", "iban": "iban|account|bank",
}
AGAINST = "page|pages|version|isbn|issn|doi|figure|fig|chapter|section|order|invoice|sku|part|commit|sha|sha1|md5|hash|checksum|digest"
CONTEXT_CHARS = 32
ROUNDS = 40
#: Where the estimates start, and the votes' worth of data that draws them there.
START_RIGHT, START_SHARE, PULL = 0.8, 0.3, 20.0

#: Columns that the scan adds.
BASE, LOOSE_SPANS = "pii_base", "pii_loose"
LABELERS = ("shape", "checksum", "gazetteer", "context", "against", "edges")


#: A private-use character that cuts a text at its matches, and what stands for it in texts that hold it.
CUT, OTHER = "\ue000", "\ue001"
#: Pieces in a block of ``offsets``.
BLOCK = 64


def running(values: Column, total: str) -> Column:
    """For each value the sum (or "max": the greatest) of those before it, 0 for the first.

    In blocks: each value looks back within its block only, and each block at the others' totals, so that the work
    for n values is about n * BLOCK, not n * n.
    """
    join = (lambda a, b: (a + b).cast("int")) if total == "sum" else (lambda a, b: F.greatest(a, b).cast("int"))
    fold = lambda v: F.aggregate(v, F.lit(0), join)

    def placed(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), (F.size(v) - 1).cast("int"), F.lit(BLOCK)), lambda i: fold(F.slice(v, i + 1, F.lit(BLOCK))))
        before = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), x))))
        return let(before, lambda b: F.transform(v, lambda _, i: join(F.get(b, F.floor(i / BLOCK).cast("int")), fold(F.slice(v, i - i % BLOCK + 1, i % BLOCK)))))

    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(placed(v)))


def spans_of(text: Column, pattern: str) -> Column:
    """The matches of a pattern in order: start, end (code points, end exclusive), value, the characters before and the one after."""
    row = "struct<start:int,end:int,value:string,before:string,after:string>"
    none = F.array().cast(f"array<{row}>")

    def placed(pieces: Column) -> Column:
        """From gap, match, gap, ..., gap."""

        def span(k: Column, at: Column) -> Column:
            start, value = F.get(at, 2 * k + 1), F.get(pieces, 2 * k + 1)
            return F.struct(start.alias("start"), (start + F.char_length(value)).cast("int").alias("end"), value.alias("value"), F.right(F.get(pieces, 2 * k), F.lit(CONTEXT_CHARS)).alias("before"), F.left(F.get(pieces, 2 * k + 2), F.lit(1)).alias("after")).cast(row)

        lengths = F.transform(pieces, lambda p: F.char_length(p))
        return let(running(lengths, "sum"), lambda at: F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 3) / 2).cast("int")), lambda k: span(k, at)))

    clean = F.when(F.contains(text, F.lit(CUT)), F.translate(text, CUT, OTHER)).otherwise(text)
    cut = F.split(F.regexp_replace(clean, pattern, f"{CUT}$0{CUT}"), CUT, -1)
    return let(cut, lambda pieces: F.when(F.size(pieces) < 3, none).otherwise(placed(pieces)))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a value pass the check sum of card numbers."""
    backward = F.transform(F.split(F.reverse(digits(value)), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    doubled = F.transform(backward, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: (a + d).cast("int")) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """The check of a base kind."""
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.substring(part(p), 1, 3).try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return F.length(digits(value)).between(12, 19) & luhn(value)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


#: Characters without which a kind cannot match; they spare most texts the pattern.
NEEDED = {"email": "@", "phone": "+"}


SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string,before:string,after:string>"


def kind_spans(text: Column, kind: str) -> Column:
    """The spans of a base kind that pass its check."""
    rank = BASE_KINDS.index(kind)
    kept = F.filter(spans_of(text, PATTERNS[kind]), lambda s: passes(kind, s["value"]))
    named = F.transform(kept, lambda s: F.struct(s["start"], F.lit(rank), s["end"], F.lit(kind), s["value"], s["before"], s["after"]).cast(SPAN))
    return F.when(F.contains(text, F.lit(NEEDED[kind])), named).otherwise(F.array().cast(f"array<{SPAN}>")) if kind in NEEDED else named


def base_spans(text: Column) -> Column:
    """All base spans with their kind, by start and then kind as listed."""
    return F.array_sort(F.concat(*[kind_spans(text, kind) for kind in BASE_KINDS]))


def loose_spans(text: Column) -> Column:
    """Candidates with the kind that their shape tells."""

    def named(s: Column) -> Column:
        v = s["value"]
        kind = F.when(F.rlike(v, F.lit("^[0-9a-f]{32,64}$")), "secret").when(F.rlike(v, F.lit(r"[\[(]\x20?at\x20?[\])]")), "email").when(F.rlike(v, F.lit("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")), "ssn").when(F.rlike(v, F.lit("^[A-Z]{2}[0-9]{2}")), "iban").when(F.length(digits(v)) == 10, "phone").otherwise("card")
        rank = F.element_at(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))]), kind)
        return F.struct(s["start"], rank, s["end"], kind, v, s["before"], s["after"]).cast(SPAN)

    found = F.when(F.rlike(text, F.lit(WRITTEN_AT)), spans_of(text, LOOSE)).otherwise(spans_of(text, LOOSE_PLAIN))
    return F.transform(found, named)


def by_kind(kind: Column, table_: dict[str, Column], default: Column) -> Column:
    out = default
    for k, c in table_.items():
        out = F.when(kind == k, c).otherwise(out)
    return out


def votes(s: Column) -> dict[str, Column]:
    """The vote of each labeler on a span: 1 for, -1 against, 0 none."""
    kind, value, before, after = s["kind"], s["value"], F.lower(s["before"]), s["after"]
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    shape = {
        "email": F.when(F.rlike(value, F.lit("^[A-Za-z0-9][^@]*@[^@]+$")), yes).otherwise(none), "ip": F.when(F.rlike(value, F.lit(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")), yes).otherwise(no),
        "card": F.when(F.length(digits(value)).isin(15, 16), yes).otherwise(none), "phone": F.when(F.rlike(value, F.lit(r"^\+")), yes).otherwise(none),
        "secret": F.when(F.length(value).isin(32, 40, 64), yes).otherwise(none), "ssn": F.when(F.rlike(value, F.lit("^(000|666|9)|-00-|-0000$")), no).otherwise(none),
    }
    same_digit = F.rlike(digits(value), F.lit("^([0-9])\\1+$"))
    checksum = {"card": F.when(luhn(value) & ~same_digit, yes).otherwise(no), "phone": F.when(same_digit, no).otherwise(none)}
    gazetteer = {
        "email": F.when(F.rlike(F.lower(value), F.lit(rf"[.)\]\x20]({TOP_DOMAINS})$")), yes).otherwise(none), "ip": F.when(F.rlike(value, F.lit(r"^(0|127|255)\.")), no).otherwise(yes),
        "card": F.when(F.rlike(digits(value), F.lit(f"^({ISSUERS})")), yes).otherwise(none), "phone": F.when(F.rlike(value, F.lit(f"^{CALLING_CODES}")), yes).otherwise(none),
    }
    context = {k: F.when(F.rlike(before, F.lit(rf"(?<![a-z])({words})\W{{0,12}}$")), yes).otherwise(none) for k, words in CONTEXT.items()}
    against = F.when(F.rlike(before, F.lit(rf"(?<![a-z])({AGAINST})\W{{0,6}}$")), no).otherwise(none)
    edges = F.when(F.rlike(after, F.lit(r"^[\p{L}\p{N}]")), no).otherwise(none)
    return {"shape": by_kind(kind, shape, none), "checksum": by_kind(kind, checksum, none), "gazetteer": by_kind(kind, gazetteer, none), "context": by_kind(kind, context, none), "against": against, "edges": edges}


#: What the scan keeps of a span: no part of the text, but the labelers' votes on it.
JUDGED = f"struct<start:int,rank:int,end:int,kind:string,{','.join(f'{x}:int' for x in LABELERS)}>"


def judged(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "end", "kind")], *[v.cast("int").alias(k) for k, v in votes(s).items()]).cast(JUDGED))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns BASE and LOOSE: the base spans and the candidates of each text, with their votes.

    The one pass over the texts; write its result, then learn from it and decide.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({BASE: judged(base_spans(body)), LOOSE_SPANS: judged(loose_spans(body))})


def vote_counts(scanned: DataFrame) -> DataFrame:
    """How many spans of the corpus have each kind and votes, base spans (known) and candidates apart."""
    rows = [scanned.select(F.lit(known).alias("known"), F.explode(column).alias("s")) for known, column in ((True, BASE), (False, LOOSE_SPANS))]
    return rows[0].union(rows[1]).select("known", "s.kind", *[f"s.{x}" for x in LABELERS]).groupBy("known", "kind", *LABELERS).agg(F.count("*").alias("n"))


Pattern = tuple[bool, str, tuple[int, ...], int]  # known, kind, votes, count


def estimate(patterns: list[Pattern], rounds: int = ROUNDS) -> tuple[dict[str, float], dict[str, float], list[float]]:
    """How often each labeler is right, each kind's share of real ones among its candidates, and each pattern's probability.

    Expectation-maximisation: each labeler that votes is right with a chance of its own, an abstention tells nothing,
    and known spans are real. Both estimates start from, and are drawn to, START_RIGHT and START_SHARE.
    """
    right = dict.fromkeys(LABELERS, START_RIGHT)
    share = dict.fromkeys(KINDS, START_SHARE)
    real: list[float] = []
    for _ in range(rounds):
        real = []
        for known, kind, vote, _n in patterns:
            odds = math.log(share[kind] / (1 - share[kind])) + sum(v * math.log(right[x] / (1 - right[x])) for x, v in zip(LABELERS, vote, strict=True))
            real.append(1.0 if known else 1 / (1 + math.exp(max(-50.0, min(50.0, -odds)))))
        for i, x in enumerate(LABELERS):
            cast = [(p if vote[i] > 0 else 1 - p, n) for p, (_, _, vote, n) in zip(real, patterns, strict=True) if vote[i]]
            right[x] = min(0.99, max(0.55, (PULL * START_RIGHT + sum(p * n for p, n in cast)) / (PULL + sum(n for _, n in cast))))
        for kind in KINDS:
            mine = [(p, n) for p, (known, k, _, n) in zip(real, patterns, strict=True) if k == kind and not known]
            share[kind] = min(0.9, max(0.1, (PULL * START_SHARE + sum(p * n for p, n in mine)) / (PULL + sum(n for _, n in mine))))
    return right, share, real


def train(patterns: list[Pattern], real: list[float], rounds: int = 1500) -> dict[str, float]:
    """Weights of the span classifier: logistic regression on the patterns' probabilities, each as often as it stands, by gradient ascent."""
    names = ["bias", *KINDS, *(f"{x}:{v}" for x in LABELERS for v in (1, -1))]
    place = {x: i for i, x in enumerate(names)}
    x = np.zeros((len(patterns), len(names)))
    for row, (_, kind, vote, _n) in zip(x, patterns, strict=True):
        row[[0, place[kind], *(place[f"{name}:{v}"] for name, v in zip(LABELERS, vote, strict=True) if v)]] = 1
    n, p = np.array([float(c) for *_, c in patterns]), np.array(real)
    w = np.zeros(len(names))
    for _ in range(rounds):
        miss = (p - 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))) * n / max(1.0, n.sum())
        w = w + 2.0 * (x.T @ miss - 1e-4 * w)
    return dict(zip(names, w.tolist(), strict=True))


def fit_classifier(patterns: list[Pattern], rounds: int = ROUNDS) -> dict[str, float]:
    """Weights of the span classifier from counted vote patterns."""
    return train(patterns, estimate(patterns, rounds)[2])


def learn(scanned: DataFrame) -> dict[str, float]:
    """Fit on the votes of the whole corpus; the counted patterns (bounded by the labelers) reach the driver."""
    return fit_classifier(sorted((r["known"], r["kind"], tuple(r[x] for x in LABELERS), r["n"]) for r in vote_counts(scanned).collect()))


def chance_of(s: Column, weights: dict[str, float]) -> Column:
    """The classifier's probability that a span is personal data."""
    total = F.lit(weights["bias"]) + by_kind(s["kind"], {k: F.lit(weights[k]) for k in KINDS}, F.lit(0.0))
    for name in LABELERS:
        total = total + F.when(s[name] == 1, weights[f"{name}:1"]).when(s[name] == -1, weights[f"{name}:-1"]).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def all_spans(weights: dict[str, float]) -> Column:
    """Base spans and the candidates that stay, by start and then kind."""
    likely = F.filter(LOOSE_SPANS, lambda s: (s["checksum"] >= 0) & (chance_of(s, weights) >= 0.5))
    # Both are in order of their starts: of the base spans before a candidate's end, the greatest end tells whether one overlaps.
    apart = let(likely, lambda extra: F.when(F.size(extra) == 0, extra).otherwise(without_overlap(extra, F.col(BASE))))
    return F.array_sort(F.concat(BASE, apart))


def without_overlap(extra: Column, base: Column) -> Column:
    """The candidates that overlap no base span. Both lists are merged by place, and running maxima tell."""
    ends = lambda rows, own: F.transform(rows, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s.alias("span")))

    def kept(rows: Column) -> Column:
        before = running(F.transform(rows, lambda r: F.when(r["own"] == 0, r["end"]).otherwise(F.lit(0))), "max")
        # Seen from the end, the least start of a base span behind: starts are mirrored to make it a maximum.
        far = F.lit(2**31 - 1)
        behind = F.reverse(running(F.reverse(F.transform(rows, lambda r: F.when(r["own"] == 0, far - r["start"]).otherwise(F.lit(0)))), "max"))
        clear = let(before, lambda b: let(behind, lambda c: F.filter(F.transform(rows, lambda r, i: F.struct(r.alias("r"), ((F.get(b, i) <= r["start"]) & (far - F.get(c, i) >= r["end"])).alias("ok"))), lambda x: (x["r"]["own"] == 1) & x["ok"])))
        return F.transform(clear, lambda x: x["r"]["span"])

    return let(F.array_sort(F.concat(ends(base, 0), ends(extra, 1))), kept)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    # Four bytes a character, so that a place is reached at once.
    part = lambda raw, lo, hi: F.decode(F.substring(raw, 4 * lo + 1, 4 * (hi - lo)), "UTF-32")

    def whole(raw: Column, found: Column) -> Column:
        def parts(before: Column) -> Column:
            each = F.transform(found, lambda s, i: F.when(s["start"] >= F.get(before, i), F.concat(part(raw, F.get(before, i), s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(""))
            last = F.array_max(F.transform(found, lambda s: s["end"]))
            return F.concat(F.array_join(each, ""), part(raw, last, F.octet_length(raw) / 4))

        return let(running(F.transform(found, lambda s: s["end"]), "max"), parts)

    return let(F.encode(text, "UTF-32"), lambda raw: let(spans, lambda found: whole(raw, found)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the personal data of each text replaced. Null stays null; a text without spans is unchanged. Columns of any name stay."""
    others = [c for c in docs.columns if c != text]
    held = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    seen = materialise(scan(docs.select(held.alias("others"), F.col(f"`{text}`").alias("text"))), "pii-scan")
    spans = seen.withColumn(BASE, all_spans(learn(seen)))
    clean = F.when(F.col("text").isNotNull() & (F.size(BASE) > 0), redacted(F.col("text"), F.col(BASE))).otherwise(F.col("text"))
    return spans.select(*[clean.alias(c) if c == text else F.col(f"others.c{others.index(c)}").alias(c) for c in docs.columns])


def scan_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: counts of base spans by kind, the hash of their list, and all spans.

    A null or empty text has no span. Repeated rows and equal keys are scanned each by itself.
    """
    rows = materialise(scan(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).drop("text"), "pii-scan")
    count = lambda kind: F.size(F.filter(BASE, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(F.col("key").alias(key), *[count(kind) for kind in BASE_KINDS], F.sha2(joined(F.col(BASE)), 256).alias("base_sha256"), joined(all_spans(learn(rows))).alias("spans"))


def op6_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    return scan_pii(table(spark, sf_dir, "documents"))
