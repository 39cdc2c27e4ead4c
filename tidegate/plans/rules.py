"""Rule detectors on windowed counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.functions import quic as Q
from tidegate.functions import traffic as T
from tidegate.operators import counters as K
from tidegate.operators import rules as R
from tidegate.plans.registry import query
from tidegate.sources.tables import http_requests, packets, sql

c = F.col
DAY = "1 day"


def daily(spark, sf):
    return K.window_counters(packets(spark, sf), DAY)


@query("rule_syn_ratio", sql("SELECT w, 'SYN_FLOOD' AS alert_type, 'CRITICAL' AS severity, concat('syn/tcp ', syn, '/', tcp) AS details FROM counters WHERE syn > 0.34 * tcp", "counters"))
def rule_syn_ratio(spark, sf):
    rule = R.Rule("SYN_FLOOD", "CRITICAL", c("syn") > 0.34 * c("tcp"), F.concat(F.lit("syn/tcp "), c("syn"), F.lit("/"), c("tcp")))
    return R.alerts(daily(spark, sf), [rule])


def attack_daily(spark, sf):
    return K.window_counters(packets(spark, sf).where(T.network_class(c("src_ip")) == "attack"), DAY, only=("packets", "udp", "syn", "icmp", "http"))


ATTACK = "(SELECT w, count(*) AS packets, count(*) FILTER (WHERE proto = 17) AS udp, count(*) FILTER (WHERE tcp_flags & 2 <> 0) AS syn, count(*) FILTER (WHERE proto = 1) AS icmp, count(*) FILTER (WHERE proto = 6 AND dst_port = 80) AS http FROM packets WHERE net = 'attack' GROUP BY w) a"


def reasons_sql(pairs, gate="TRUE"):
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {gate} AND {cond} THEN {text} END" for cond, text in pairs) + ")"


FLOOD = [("udp > 18", "concat('UDP_FLOOD: ', udp)"), ("syn > 18", "concat('SYN_FLOOD: ', syn)"), ("icmp > 18", "concat('ICMP_FLOOD: ', icmp)"), ("http > 18", "concat('HTTP_FLOOD: ', http)")]


@query("rule_aggregate_flood", sql(f"SELECT w, CASE WHEN packets > 75 AND (udp > 18 OR syn > 18 OR icmp > 18 OR http > 18) THEN 'HIGH' ELSE 'NONE' END AS alert_level, {reasons_sql(FLOOD, 'packets > 75')} AS reasons FROM {ATTACK}"))
def rule_aggregate_flood(spark, sf):
    return R.evaluate(attack_daily(spark, sf), R.aggregate_flood(18, 18, 18, 18), c("packets") > 75).select("w", "alert_level", "reasons")


@query("rule_multi_attack", sql(f"SELECT w, (CAST(udp > 15 AS INT) + CAST(syn > 15 AS INT) + CAST(icmp > 15 AS INT)) >= 2 AND NOT (udp > 18 OR syn > 18 OR icmp > 18 OR http > 18) AS multi FROM {ATTACK}"))
def rule_multi_attack(spark, sf):
    single = (c("udp") > 18) | (c("syn") > 18) | (c("icmp") > 18) | (c("http") > 18)
    return attack_daily(spark, sf).select("w", (R.multi_attack(15, 15, 15) & ~single).alias("multi"))


METRICS = {
    "udp": "proto = 17", "syn": "tcp_flags & 2 <> 0", "icmp": "proto = 1", "http": "proto = 6 AND dst_port = 80", "dns": "proto = 17 AND (src_port = 53 OR dst_port = 53)",
    "ntp": "proto = 17 AND (src_port = 123 OR dst_port = 123) AND NOT (src_port = 53 OR dst_port = 53)", "pure_ack": "tcp_flags = 16", "frag": "frag_off & 16383 <> 0", "packets": "TRUE",
}
#: Scaled to the daily windows of the fixtures: (limit of attack sources, limit of baseline sources).
PER_IP = {"udp": (1, 2), "syn": (1, 2), "icmp": (1, 2), "http": (1, 2), "dns": (0, None), "ntp": (0, None), "pure_ack": (1, None), "frag": (1, None), "packets": (5, 6)}


def per_ip(spark, sf):
    p = packets(spark, sf).where(c("src_ip") != T.SERVER_IP).withColumn("net_class", T.network_class(c("src_ip")))
    return K.window_counters(p, DAY, ("src_ip", "net_class"), only=tuple(METRICS))


PER_IP_SQL = "(SELECT w, src_ip, net, " + ", ".join(f"count(*) FILTER (WHERE {cond}) AS {m}" for m, cond in METRICS.items()) + " FROM packets WHERE src_ip <> 168427778 GROUP BY w, src_ip, net) s"


def hit_sql(metric):
    attack, baseline = PER_IP[metric]
    return f"(net = 'attack' AND {metric} > {attack})" + (f" OR (net <> 'attack' AND {metric} > {baseline})" if baseline is not None else "")


def add_per_ip(name, metric, severity):
    @query(name, sql(f"SELECT w, src_ip, '{severity}' AS severity, concat('{metric} ', {metric}) AS details FROM {PER_IP_SQL} WHERE {hit_sql(metric)}"))
    def rule(spark, sf):
        found = R.alerts(per_ip(spark, sf), R.per_source({metric: PER_IP[metric]}), keep=("w", "src_ip"))
        return found.select("w", "src_ip", F.lit(severity).alias("severity"), "details")

    rule.__name__ = name


for _name, _metric, _severity in (
    ("rule_per_ip_udp", "udp", "HIGH"), ("rule_per_ip_syn", "syn", "HIGH"), ("rule_per_ip_icmp", "icmp", "HIGH"), ("rule_per_ip_http", "http", "HIGH"), ("rule_per_ip_dns_amp", "dns", "HIGH"),
    ("rule_per_ip_ntp_amp", "ntp", "HIGH"), ("rule_per_ip_ack", "pure_ack", "HIGH"), ("rule_per_ip_frag", "frag", "MEDIUM"), ("rule_per_ip_packet", "packets", "MEDIUM"),
):
    add_per_ip(_name, _metric, _severity)


EVENTS_SQL = " UNION ALL ".join(f"SELECT '{m.upper()}' AS alert_type, src_ip, concat('{m} ', {m}) AS details, {m} AS value FROM {PER_IP_SQL} WHERE {hit_sql(m)}" for m in METRICS)


@query("rule_event_counts", sql(f"SELECT alert_type, count(*) AS events, count(DISTINCT src_ip) AS sources, 'HIGH' AS severity, string_agg(DISTINCT details, ' | ' ORDER BY details) AS reasons FROM ({EVENTS_SQL}) e GROUP BY alert_type"))
def rule_event_counts(spark, sf):
    """Events and sources of each rule, its greatest severity, and its different reasons in order.

    A reason is a metric and its value in a window, so there are few of them, and they are counted before they are gathered.
    """
    found = R.alerts(per_ip(spark, sf), R.per_source(PER_IP), keep=("w", "src_ip")).withColumn("code", T.alert_code(c("severity")))
    by_source = found.groupBy("alert_type", "src_ip").agg(F.count("*").alias("n"))
    counts = by_source.groupBy("alert_type").agg(F.sum("n").alias("events"), F.count("*").alias("sources"))
    reasons = found.groupBy("alert_type", "details").agg(F.max("code").alias("code")).groupBy("alert_type").agg(T.alert_level(F.max("code")).alias("severity"), F.array_join(F.sort_array(F.collect_list("details")), " | ").alias("reasons"))
    return counts.join(reasons, "alert_type")


HTTP = """(SELECT w, sum(n) AS packets, sum(CASE WHEN net = 'attack' THEN n ELSE 0 END) AS attack, count(DISTINCT src_ip) AS ips, max(path_n) AS top_n, sum(CASE WHEN method = 'GET' THEN n ELSE 0 END) AS gets, max(ip_n) AS top_ip, sum(CASE WHEN agent = '' OR agent LIKE 'curl%' THEN n ELSE 0 END) AS odd_agents FROM (
  SELECT w, net, src_ip, method, agent, n, sum(n) OVER (PARTITION BY w, path) AS path_n, sum(n) OVER (PARTITION BY w, src_ip) AS ip_n FROM (
    SELECT w, net, src_ip, split_part(payload, ' ', 1) AS method, split_part(payload, ' ', 2) AS path, regexp_extract(payload, 'User-Agent: ([^\\r\\n]*)', 1) AS agent, count(*) AS n FROM http_requests GROUP BY ALL) a) b GROUP BY w) h"""
HEAVY = "(SELECT w, count(*) AS heavy FROM (SELECT w, src_ip, count(*) AS n FROM http_requests GROUP BY w, src_ip HAVING count(*) > 1) x GROUP BY w) y"
HTTP_SQL = f"(SELECT h.*, coalesce(heavy, 0) AS heavy FROM {HTTP} LEFT JOIN {HEAVY} USING (w)) z"


def http_windows(spark, sf):
    """Per window: requests, of attackers, sources, requests of the top path and of the top source, GETs, odd agents, heavy sources."""
    rows = http_requests(spark, sf).select(K.window_start(DAY).alias("w"), "src_ip", T.network_class(c("src_ip")).alias("net"), T.request_method(c("payload")).alias("m"), T.request_path(c("payload")).alias("path"), T.request_header(c("payload"), "User-Agent").alias("agent"))
    odd = (c("agent") == "") | F.startswith("agent", F.lit("curl"))
    total = rows.groupBy("w").agg(F.count("*").alias("packets"), T.count_where(c("net") == "attack").alias("attack"), T.count_where(c("m") == "GET").alias("gets"), T.count_where(odd).alias("odd_agents"))
    paths = rows.groupBy("w", "path").agg(F.count("*").alias("n")).groupBy("w").agg(F.max("n").alias("top_n"))
    sources = rows.groupBy("w", "src_ip").agg(F.count("*").alias("n")).groupBy("w").agg(F.count("*").alias("ips"), F.max("n").alias("top_ip"), T.count_where(c("n") > 1).alias("heavy"))
    return total.join(paths, "w").join(sources, "w").transform(K.named)


HTTP_RULES = {
    "rule_http_attack_rate": ("HIGH", lambda: (c("attack") > 0.3 * c("packets")) & (c("packets") > 50), "attack > 0.3 * packets AND packets > 50"),
    "rule_http_url_conc": ("MEDIUM", lambda: c("top_n") > 0.1 * c("packets"), "top_n > 0.1 * packets"),
    "rule_http_botnet": ("MEDIUM", lambda: (c("ips") > 50) & (c("packets") < 2 * c("ips")), "ips > 50 AND packets < 2 * ips"),
    "rule_http_heavy": ("LOW", lambda: c("heavy") > 10, "heavy > 10"),
    "rule_http_method": ("LOW", lambda: c("gets") > 0.8 * c("packets"), "gets > 0.8 * packets"),
    "rule_http_ip_rate": ("HIGH", lambda: c("top_ip") > 3, "top_ip > 3"),
    "rule_http_ua": ("LOW", lambda: c("odd_agents") > 0.35 * c("packets"), "odd_agents > 0.35 * packets"),
}


def add_http(name, severity, condition, text):
    @query(name, sql(f"SELECT w, {text} AS fired, CASE WHEN {text} THEN '{severity}' ELSE 'NONE' END AS alert_level FROM {HTTP_SQL}", "packets", "http_requests"))
    def rule(spark, sf):
        rows = R.evaluate(http_windows(spark, sf), [R.Rule(name, severity, condition())])
        return rows.select("w", (c("alert_code") > 0).alias("fired"), "alert_level")

    rule.__name__ = name


for _name, (_severity, _condition, _text) in HTTP_RULES.items():
    add_http(_name, _severity, _condition, _text)


@query("rule_quic_jumps", sql("SELECT w, CAST(count(*) FILTER (WHERE jump > 1000) AS BIGINT) AS jumps, count(*) FILTER (WHERE jump > 1000) > 3 AS fired FROM (SELECT w, pkt_id - lag(pkt_id) OVER (PARTITION BY src_ip ORDER BY ts, pkt_id) AS jump FROM packets WHERE proto = 17 AND pkt_id % 3 < 2) s GROUP BY w"))
def rule_quic_jumps(spark, sf):
    rows = Q.acknowledged_jumps(Q.with_sample_payload(packets(spark, sf).where(c("proto") == T.UDP)))
    return rows.groupBy(K.window_start(DAY).alias("w")).agg(T.count_where(c("jump") > 1000).alias("jumps")).transform(K.named).withColumn("fired", c("jumps") > 3)


@query("rule_quic_bursts", sql("SELECT strftime(date_trunc('day', make_timestamp(pane * 43200000000)), '%Y-%m-%d %H:%M:%S') AS w, count(*) AS bursts, count(*) > 3 AS fired FROM (SELECT src_ip, epoch_us(ts) // 43200000000 AS pane, count(*) AS n FROM packets WHERE proto = 17 AND pkt_id % 3 < 2 GROUP BY 1, 2 HAVING count(*) > 1) s GROUP BY 1"))
def rule_quic_bursts(spark, sf):
    """Bursts of a day; panes and limits are scaled to the fixture as in ``win_ack_burst``."""
    acks = Q.acknowledgements(Q.with_sample_payload(packets(spark, sf).where(c("proto") == T.UDP)))
    days = Q.ack_bursts(acks, "12 hours", 1).groupBy(F.date_format(F.date_trunc("day", "pane"), "yyyy-MM-dd HH:mm:ss").alias("w")).agg(F.count("*").alias("bursts"))
    return days.withColumn("fired", c("bursts") > 3)


@query("alert_severity_merge", sql("SELECT w, CASE WHEN syn > 0.34 * tcp THEN 'HIGH' WHEN udp > 0.21 * packets THEN 'MEDIUM' WHEN small > 0.25 * packets THEN 'LOW' ELSE 'NONE' END AS alert_level, " + reasons_sql([("small > 0.25 * packets", "'small'"), ("udp > 0.21 * packets", "'udp'"), ("syn > 0.34 * tcp", "'syn'")]) + " AS reasons FROM counters", "counters"))
def alert_severity_merge(spark, sf):
    rules = [R.Rule("small", "LOW", c("small") > 0.25 * c("packets")), R.Rule("udp", "MEDIUM", c("udp") > 0.21 * c("packets")), R.Rule("syn", "HIGH", c("syn") > 0.34 * c("tcp"))]
    return R.evaluate(daily(spark, sf), rules).select("w", "alert_level", "reasons")
