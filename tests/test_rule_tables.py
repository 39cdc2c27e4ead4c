"""Rules as rows: conjunctions, alternatives, missing metrics, and windows that the documented limits catch."""

import pytest

from tidegate.operators import rule_tables as M
from tidegate.plans import documented as D

QUIET = {"pps": 100.0, "gbps": 0.1, "tcp_ratio": 0.8, "udp_ratio": 0.15, "icmp_ratio": 0.05, "syn_ratio": 0.2, "ack_ratio": 0.6, "psh_ratio": 0.3, "frag_ratio": 0.0, "small_pkt_ratio": 0.2, "avg_pkt_size": 300.0, "entropy_src_ip": 6.0, "unique_src_ips": 200.0, "unique_dst_ports": 40.0, "web_share": 0.3, "reflector_share": 0.0}
SYN = {"pps": 60000, "tcp_ratio": 0.95, "udp_ratio": 0.05, "syn_ratio": 0.9, "ack_ratio": 0.1, "unique_src_ips": 9000, "unique_dst_ports": 2, "entropy_src_ip": 12.0}


def metrics(spark, **windows):
    rows = [(w, *(float(v) for v in (QUIET | more).values())) for w, more in windows.items()]
    return spark.createDataFrame(rows, "w string, " + ", ".join(f"{k} double" for k in QUIET))


def evaluated(spark, rules, **windows):
    found = M.evaluate(metrics(spark, **windows), M.conditions_of(spark, rules)).collect()
    return {(r["w"], r["rule"]): r for r in found}


def test_documented_rules_fire(spark):
    cases = {
        "doc_rule_udp": {"udp_ratio": 0.85, "tcp_ratio": 0.1, "pps": 20000}, "doc_rule_icmp": {"icmp_ratio": 0.6, "tcp_ratio": 0.2, "pps": 6000}, "doc_rule_http": {"tcp_ratio": 0.95, "psh_ratio": 0.8, "web_share": 0.9, "pps": 4000},
        "doc_rule_amplification": {"udp_ratio": 0.95, "tcp_ratio": 0.0, "avg_pkt_size": 450, "reflector_share": 0.9, "unique_src_ips": 50}, "doc_rule_frag": {"frag_ratio": 0.6, "avg_pkt_size": 90}, "doc_rule_ack": {"tcp_ratio": 0.95, "ack_ratio": 0.95, "syn_ratio": 0.05, "pps": 9000},
        "doc_rule_volumetric": {"pps": 60000, "tcp_ratio": 0.5, "udp_ratio": 0.4},
    }
    got = evaluated(spark, D.DOCUMENTED, quiet={}, **cases)
    for rule in cases:
        assert got[rule, rule]["fired"] and not got["quiet", rule]["fired"]
        # One condition less and the rule is silent.
        for metric in cases[rule]:
            if any(x[1] == rule and x[6] == metric for x in D.DOCUMENTED):
                less = {k: v for k, v in cases[rule].items() if k != metric}
                if rule == "doc_rule_volumetric" and metric == "udp_ratio":
                    less["udp_ratio"] = 0.1
                if (QUIET | less)[metric] != cases[rule][metric] and (rule, metric) not in (("doc_rule_volumetric", "tcp_ratio"),):
                    assert not evaluated(spark, tuple(x for x in D.DOCUMENTED if x[1] == rule), one=less)["one", rule]["fired"], (rule, metric)


def test_scores_and_tree(spark):
    got = evaluated(spark, D.DOCUMENTED, quiet={}, syn=SYN, udp={"pps": 20000, "tcp_ratio": 0.1, "udp_ratio": 0.85})
    assert got["quiet", "doc_threat_score"]["score"] == 0 and got["quiet", "normal"]["fired"]
    assert got["syn", "doc_threat_score"]["score"] == 3 + 2 + 3 + 2 + 4 + 3 and got["syn", "doc_threat_score"]["signals"] == ["high_pps", "high_syn", "high_unique_ips", "low_ack", "low_dst_ports", "skewed_tcp_ratio"]
    assert got["syn", "doc_threat_score_v2"]["score"] == 2 + 2 + 3 + 3 + 1
    assert got["udp", "doc_threat_score"]["score"] == 2  # a low share of TCP is skewed too; pps is not over 20,000
    assert [x for x in D.LEAVES if got["syn", x]["fired"]] == ["syn_flood"] and [x for x in D.LEAVES if got["udp", x]["fired"]] == ["udp_flood"]
    assert sum(n for _, n, _ in {(x[3], x[5], x[1]) for x in D.DOCUMENTED if x[1] == "doc_threat_score"}) == 20


def test_missing_metrics_and_relations(spark):
    rows = spark.createDataFrame([("a", 5.0, None), ("b", None, 2.0)], "w string, x double, y double")
    rules = (*M.conjunction("s", "both", "LOW", ("x", ">", 1), ("y", "<", 3)), *M.scored("s", "either", ("e", 4, (("x", ">=", 5), ("y", "<=", 1))), ("f", 1, (("y", "=", 2),))), *M.conjunction("s", "absent", "LOW", ("z", ">", 0)))
    got = {(r["w"], r["rule"]): (r["fired"], r["score"]) for r in M.evaluate(rows, M.conditions_of(spark, rules + rules)).collect()}
    assert got == {("a", "both"): (False, 1), ("b", "both"): (False, 1), ("a", "either"): (False, 4), ("b", "either"): (False, 0)}
    assert M.evaluate(rows.limit(0), M.conditions_of(spark, rules)).count() == 0


@pytest.mark.parametrize("limits", ["documented", "scaled"])
def test_sets_of_limits_are_complete(limits):
    rules = {"documented": D.DOCUMENTED, "scaled": D.SCALED}[limits]
    assert {x[1] for x in rules} == {x[1] for x in D.DOCUMENTED} and {x[0] for x in rules} == {limits} and len(rules) == len(D.DOCUMENTED)
