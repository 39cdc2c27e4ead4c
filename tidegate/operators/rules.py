"""Detection rules: a rule is a name, a severity, a condition and a reason, all columns of one row of counters.

One evaluator serves every detector and every window width, in batch and in streams: rules are projections of the
aggregated row, so nothing is shuffled for them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions import traffic as T

c = F.col


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    condition: Column
    reason: Column | None = None

    def text(self) -> Column:
        return self.reason if self.reason is not None else F.lit(self.name)


def evaluate(rows: DataFrame, rules: list[Rule], gate: Column | None = None) -> DataFrame:
    """``rows`` with alert_code (the greatest severity of the rules that fire), alert_level and reasons (in the order of the rules)."""
    on = [F.coalesce(r.condition if gate is None else gate & r.condition, F.lit(False)) for r in rules]
    codes = F.greatest(F.lit(0), *[F.when(x, T.ALERT_CODES[r.severity]).otherwise(0) for x, r in zip(on, rules, strict=True)])
    reasons = F.array_join(F.array_compact(F.array(*[F.when(x, r.text()) for x, r in zip(on, rules, strict=True)])), "; ")
    return rows.withColumns({"alert_code": codes.cast("int"), "reasons": reasons}).withColumn("alert_level", T.alert_level(c("alert_code")))


def alerts(rows: DataFrame, rules: list[Rule], gate: Column | None = None, keep: tuple[str, ...] = ("w",)) -> DataFrame:
    """A row for each rule that fires: keep, alert_type, severity, details."""
    ok = F.lit(True) if gate is None else gate
    fired = F.array_compact(F.array(*[F.when(F.coalesce(ok & r.condition, F.lit(False)), F.struct(F.lit(r.name).alias("alert_type"), F.lit(r.severity).alias("severity"), r.text().alias("details"))) for r in rules]))
    return rows.select(*keep, F.explode(fired).alias("a")).select(*keep, "a.*")


def above(metric: str, limit: float, severity: str, name: str | None = None, extra: Column | None = None) -> Rule:
    """A rule that fires where a column is above a limit."""
    condition = c(metric) > limit
    name = name or f"{metric.upper()}_FLOOD"
    return Rule(name, severity, condition if extra is None else condition & extra, F.concat(F.lit(f"{name}: "), c(metric).cast("string")))


def aggregate_flood(udp: float = 20000, syn: float = 30000, icmp: float = 10000, http: float = 15000) -> list[Rule]:
    return [above(m, v, "HIGH") for m, v in (("udp", udp), ("syn", syn), ("icmp", icmp), ("http", http))]


def multi_attack(udp: float = 10000, syn: float = 10000, icmp: float = 5000, least: int = 2) -> Column:
    """Whether ``least`` or more of the three counters are above their limits."""
    return (c("udp") > udp).cast("int") + (c("syn") > syn).cast("int") + (c("icmp") > icmp).cast("int") >= least


def per_source(limits: dict[str, tuple[float, float | None]]) -> list[Rule]:
    """metric: (limit of attack sources, limit of baseline sources or None); needs net_class."""
    out = []
    for metric, (attack, baseline) in limits.items():
        attack_hit = (c("net_class") == "attack") & (c(metric) > attack)
        hit = attack_hit if baseline is None else attack_hit | ((c("net_class") != "attack") & (c(metric) > baseline))
        out.append(Rule(metric.upper(), "HIGH", hit, F.concat(F.lit(f"{metric} "), c(metric).cast("string"))))
    return out
