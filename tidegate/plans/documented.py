"""Rules and scores that are specified in documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.functions import traffic as T
from tidegate.operators import blocks as B
from tidegate.operators import counters as K
from tidegate.operators import rule_tables as M
from tidegate.operators.ewma import ewma
from tidegate.plans.counters import FEATURES, ratio_sql
from tidegate.plans.registry import query
from tidegate.sources.tables import packets, sql

c = F.col
DAY = "1 day"

def week():
    """The block of a daily row."""
    return F.floor(F.unix_timestamp("w", "yyyy-MM-dd HH:mm:ss") / (7 * 86400))


# The documented rules, severities, weights and limits.
DOCUMENTED = (
    *M.conjunction("documented", "doc_rule_udp", "HIGH", ("udp_ratio", ">", 0.80), ("pps", ">", 10000)),
    *M.conjunction("documented", "doc_rule_icmp", "MEDIUM", ("icmp_ratio", ">", 0.50), ("pps", ">", 5000)),
    *M.conjunction("documented", "doc_rule_http", "HIGH", ("tcp_ratio", ">", 0.90), ("psh_ratio", ">", 0.70), ("web_share", ">", 0.80), ("pps", ">", 3000)),
    *M.conjunction("documented", "doc_rule_amplification", "CRITICAL", ("udp_ratio", ">", 0.90), ("avg_pkt_size", ">", 400), ("reflector_share", ">", 0.80), ("unique_src_ips", "<", 100)),
    *M.conjunction("documented", "doc_rule_frag", "HIGH", ("frag_ratio", ">", 0.50), ("avg_pkt_size", "<", 100)),
    *M.conjunction("documented", "doc_rule_ack", "HIGH", ("tcp_ratio", ">", 0.90), ("ack_ratio", ">", 0.90), ("syn_ratio", "<", 0.10), ("pps", ">", 8000)),
    *M.conjunction("documented", "doc_rule_volumetric", "CRITICAL", ("pps", ">", 50000), ("tcp_ratio", ">", 0.30), ("tcp_ratio", "<", 0.70), ("udp_ratio", ">", 0.20), ("udp_ratio", "<", 0.60)),
    *M.scored("documented", "doc_threat_score",
        ("high_pps", 3, (("pps", ">", 20000),)), ("skewed_tcp_ratio", 2, (("tcp_ratio", ">", 0.9), ("tcp_ratio", "<", 0.5))), ("high_syn", 3, (("syn_ratio", ">", 0.7),)), ("low_ack", 2, (("ack_ratio", "<", 0.3),)),
        ("high_unique_ips", 4, (("unique_src_ips", ">", 5000),)), ("low_dst_ports", 3, (("unique_dst_ports", "<", 10),)), ("high_fragmentation", 2, (("frag_ratio", ">", 0.3),)), ("large_packets", 1, (("avg_pkt_size", ">", 500),))),
    # Weights are documented; where no limit is, that of the other documented rules is taken, and 10 bits of entropy.
    *M.scored("documented", "doc_threat_score_v2",
        ("high_pps", 2, (("pps", ">", 20000),)), ("skewed_ratio", 2, (("tcp_ratio", ">", 0.9), ("tcp_ratio", "<", 0.5))), ("high_entropy", 3, (("entropy_src_ip", ">", 10),)), ("low_cardinality", 3, (("unique_dst_ports", "<", 10),)), ("tcp_syn_heavy", 1, (("syn_ratio", ">", 0.7),))),
    *M.conjunction("documented", "syn_flood", "NONE", ("pps", ">", 10000), ("tcp_ratio", ">", 0.90), ("syn_ratio", ">", 0.70)),
    *M.conjunction("documented", "http_flood", "NONE", ("pps", ">", 10000), ("tcp_ratio", ">", 0.90), ("syn_ratio", "<=", 0.70), ("psh_ratio", ">", 0.70)),
    *M.conjunction("documented", "udp_flood", "NONE", ("pps", ">", 10000), ("tcp_ratio", "<=", 0.90), ("udp_ratio", ">", 0.80)),
    *M.conjunction("documented", "icmp_flood", "NONE", ("pps", ">", 10000), ("tcp_ratio", "<=", 0.90), ("udp_ratio", "<=", 0.80), ("icmp_ratio", ">", 0.50)),
    *M.conjunction("documented", "normal", "NONE", ("pps", "<=", 10000)),
    *(x for m, r, v in (("pps", ">", 100000), ("gbps", ">", 10.0), ("syn_ratio", ">", 0.7), ("udp_ratio", ">", 0.8), ("frag_ratio", ">", 0.3), ("entropy_src_ip", "<", 3.0), ("small_pkt_ratio", ">", 0.6)) for x in M.conjunction("documented", f"threshold_{m}", "HIGH", (m, r, v))),
)
#: Limits for the daily windows of the given tables, which hold a packet in four minutes: (metric, relation, documented value) to value.
SCALE = {
    ("pps", ">", 10000.0): 0.0037, ("pps", "<=", 10000.0): 0.0037, ("pps", ">", 5000.0): 0.0036, ("pps", ">", 3000.0): 0.0035, ("pps", ">", 8000.0): 0.0036, ("pps", ">", 50000.0): 0.0038, ("pps", ">", 20000.0): 0.0039, ("pps", ">", 100000.0): 0.0039, ("gbps", ">", 10.0): 7e-9,
    ("udp_ratio", ">", 0.8): 0.2, ("udp_ratio", "<=", 0.8): 0.2, ("udp_ratio", ">", 0.9): 0.19, ("udp_ratio", ">", 0.2): 0.18, ("icmp_ratio", ">", 0.5): 0.2, ("tcp_ratio", ">", 0.9): 0.6, ("tcp_ratio", "<=", 0.9): 0.6, ("tcp_ratio", "<", 0.5): 0.57,
    ("psh_ratio", ">", 0.7): 0.29, ("web_share", ">", 0.8): 0.35, ("avg_pkt_size", ">", 400.0): 205.0, ("avg_pkt_size", ">", 500.0): 210.0, ("avg_pkt_size", "<", 100.0): 212.0, ("reflector_share", ">", 0.8): 0.02, ("unique_src_ips", "<", 100.0): 140.0, ("unique_src_ips", ">", 5000.0): 130.0, ("unique_dst_ports", "<", 10.0): 9.5,
    ("frag_ratio", ">", 0.5): 0.09, ("frag_ratio", ">", 0.3): 0.1, ("ack_ratio", ">", 0.9): 0.65, ("ack_ratio", "<", 0.3): 0.65, ("syn_ratio", "<", 0.1): 0.36, ("syn_ratio", ">", 0.7): 0.34, ("syn_ratio", "<=", 0.7): 0.34, ("entropy_src_ip", "<", 3.0): 6.4, ("entropy_src_ip", ">", 10.0): 6.45, ("small_pkt_ratio", ">", 0.6): 0.24,
}
SCALED = tuple(("scaled", *x[1:8], SCALE.get((x[6], x[7], x[8]), x[8])) for x in DOCUMENTED)

METRICS = f"""metrics AS (SELECT f.*, m.psh_ratio, m.web_share, m.reflector_share FROM ({FEATURES}) f JOIN (SELECT w, {ratio_sql("count(*) FILTER (WHERE tcp_flags & 8 <> 0)", "count(*) FILTER (WHERE proto = 6)")} AS psh_ratio,
  {ratio_sql("count(*) FILTER (WHERE dst_port IN (80, 443))", "count(*)")} AS web_share, {ratio_sql("count(*) FILTER (WHERE proto = 17 AND src_port IN (53, 123))", "count(*)")} AS reflector_share FROM packets GROUP BY w) m USING (w))"""


def hold_sql(rule: str, limits: tuple) -> list[tuple[str, int]]:
    """The condition and weight of each signal of a rule."""
    signals: dict[str, list] = {}
    for _, name, _, s, mode, weight, metric, relation, value in limits:
        if name == rule:
            signals.setdefault(s, [mode, weight, []])[2].append(f"coalesce({metric} {relation} {value!r}, false)")
    return [(f"({(' OR ' if mode == 'any' else ' AND ').join(parts)})", weight) for mode, weight, parts in signals.values()]


def both_sql(body) -> str:
    """The SQL of each set of limits, over the metrics."""
    parts = [f"SELECT w, '{name}' AS limits, {body(limits)} FROM metrics" for name, limits in (("documented", DOCUMENTED), ("scaled", SCALED))]
    return sql("", "counters").rstrip() + ",\n" + METRICS + "\n" + " UNION ALL ".join(parts)


def fired_sql(rule: str, limits: tuple) -> str:
    return " AND ".join(x for x, _ in hold_sql(rule, limits))


def score_sql(rule: str, limits: tuple) -> str:
    return " + ".join(f"CASE WHEN {x} THEN {n} ELSE 0 END" for x, n in hold_sql(rule, limits))


def daily(spark, sf, *rules):
    """Each day evaluated under both sets of limits."""
    conditions = M.conditions_of(spark, tuple(x for x in (*DOCUMENTED, *SCALED) if x[1] in rules))
    return M.evaluate(M.metric_rows(packets(spark, sf), DAY, 86400.0), conditions)


def add(name, severity):
    @query(name, both_sql(lambda limits: f"CASE WHEN {fired_sql(name, limits)} THEN '{severity}' ELSE 'NONE' END AS alert_level"))
    def rule(spark, sf):
        return daily(spark, sf, name).select("w", "limits", F.when(c("fired"), c("severity")).otherwise("NONE").alias("alert_level"))

    rule.__name__ = name


for _name, _severity in dict.fromkeys((x[1], x[2]) for x in DOCUMENTED if x[1].startswith("doc_rule_")):
    add(_name, _severity)


def bands(score: str) -> str:
    return f"CASE WHEN {score} >= 15 THEN 'CRITICAL' WHEN {score} >= 10 THEN 'HIGH' WHEN {score} >= 7 THEN 'MEDIUM' ELSE 'NONE' END"


@query("doc_threat_score", both_sql(lambda limits: f"CAST({score_sql('doc_threat_score', limits)} AS BIGINT) AS score, {bands('(' + score_sql('doc_threat_score', limits) + ')')} AS band"))
def doc_threat_score(spark, sf):
    return daily(spark, sf, "doc_threat_score").select("w", "limits", "score", F.expr(bands("score")).alias("band"))


@query("doc_threat_score_v2", both_sql(lambda limits: f"CAST({score_sql('doc_threat_score_v2', limits)} AS BIGINT) AS score, ({score_sql('doc_threat_score_v2', limits)}) >= 7 AS alert"))
def doc_threat_score_v2(spark, sf):
    return daily(spark, sf, "doc_threat_score_v2").select("w", "limits", "score", (c("score") >= 7).alias("alert"))


LEAVES = ("syn_flood", "http_flood", "udp_flood", "icmp_flood", "normal")


@query("doc_decision_tree", both_sql(lambda limits: "CASE " + " ".join(f"WHEN {fired_sql(x, limits)} THEN '{x}'" for x in LEAVES) + " ELSE 'unclassified' END AS verdict"))
def doc_decision_tree(spark, sf):
    """Each leaf is the conjunction of the conditions on its path; a window reaches one leaf or none."""
    leaves = daily(spark, sf, *LEAVES)
    return leaves.groupBy("w", "limits").agg(F.coalesce(F.max(F.when(c("fired"), c("rule"))), F.lit("unclassified")).alias("verdict"))


THRESHOLDS = tuple(dict.fromkeys(x[1] for x in DOCUMENTED if x[1].startswith("threshold_")))


@query("rule_config_thresholds", both_sql(lambda limits: "unnest(list_filter([" + ", ".join(f"CASE WHEN {fired_sql(x, limits)} THEN '{x.removeprefix('threshold_')}' END" for x in THRESHOLDS) + "], lambda x: x IS NOT NULL)) AS metric"))
def rule_config_thresholds(spark, sf):
    """The metrics of each window that are beyond their limit."""
    return daily(spark, sf, *THRESHOLDS).where("fired").select("w", "limits", F.replace("rule", F.lit("threshold_"), F.lit("")).alias("metric"))


EWMA = """, n AS (SELECT w, packets, row_number() OVER (ORDER BY w) AS k FROM counters),
e AS (WITH RECURSIVE r(k, w, packets, m, v, z) AS (SELECT k, w, packets, CAST(packets AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE FROM n WHERE k = 1
  UNION ALL SELECT n.k, n.w, n.packets, 0.1::DOUBLE * n.packets + 0.9::DOUBLE * r.m, 0.9::DOUBLE * (r.v + 0.1::DOUBLE * (n.packets - r.m) * (n.packets - r.m)), CASE WHEN r.v > 0 THEN (n.packets - r.m) / sqrt(r.v) ELSE 0 END FROM n JOIN r ON n.k = r.k + 1) SELECT * FROM r)
SELECT w, round(m, 6) AS ewma, round(z, 6) AS z, z > 3 AS alert FROM e"""


@query("doc_ewma_zscore", sql("", "counters").rstrip() + EWMA)
def doc_ewma_zscore(spark, sf):
    """z is the distance of a window from the mean before it, in deviations before it; the series is worked out in blocks."""
    rows = B.numbered(K.window_counters(packets(spark, sf), DAY, only=("packets",)), "w", week())
    return ewma(rows, "packets", block_rows=7).join(rows, "place").select("w", F.round("mean", 6).alias("ewma"), F.round("z", 6).alias("z"), (c("z") > 3).alias("alert"))


@query("doc_flash", sql("SELECT w, CAST(packets - lag(packets) OVER (ORDER BY w) AS BIGINT) AS delta, coalesce(packets - lag(packets) OVER (ORDER BY w) > 20, false) AS flash FROM counters", "counters"))
def doc_flash(spark, sf):
    rows = B.numbered(K.window_counters(packets(spark, sf), DAY, only=("packets",)), "w", week())
    rows = B.lagged(rows, "packets", "before", block_rows=16).withColumn("delta", c("packets") - c("before"))
    return rows.select("w", "delta", F.coalesce(c("delta") > 20, F.lit(False)).alias("flash"))


@query("doc_syn_only_flows", sql("SELECT src_ip, src_port, dst_port, count(*) AS packets FROM packets WHERE proto = 6 GROUP BY src_ip, src_port, dst_port HAVING bit_or(tcp_flags) & 2 <> 0 AND bit_or(tcp_flags) & 16 = 0 AND count(*) < 5"))
def doc_syn_only_flows(spark, sf):
    flows = packets(spark, sf).where(c("proto") == T.TCP).groupBy("src_ip", "src_port", "dst_port").agg(F.bit_or("tcp_flags").alias("flags"), F.count("*").alias("packets"))
    return flows.where(T.has_flag(c("flags"), T.SYN) & ~T.has_flag(c("flags"), T.ACK) & (c("packets") < 5)).drop("flags")


@query("doc_entropy_alert", sql("SELECT w, entropy(src_ip) > 6.5 AND count(DISTINCT dst_port) < 12 AS alert FROM packets GROUP BY w"))
def doc_entropy_alert(spark, sf):
    p = packets(spark, sf)
    rows = K.entropy(K.key_counts(p, "src_ip", DAY), "e", "n").join(K.entropy(K.key_counts(p, "dst_port", DAY), "e2", "ports"), "w")
    return rows.select("w", ((c("e") > 6.5) & (c("ports") < 12)).alias("alert"))
