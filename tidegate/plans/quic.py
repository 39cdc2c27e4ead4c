"""QUIC counters and rules from payloads, both directions of a client under its address.

All given packets go to the server. For these queries those from a service port are turned round, so that they come
from the server, and a payload is made from a packet's number: a third is no QUIC, the others hold one to four
acknowledgement frames (``quic_traffic``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions import quic as Q
from tidegate.functions import traffic as T
from tidegate.operators import quic as O
from tidegate.operators import rules as R
from tidegate.plans.registry import query
from tidegate.sources.tables import SQL, packets

c = F.col
DAY = "1 day"
#: Limits scaled to daily windows of the fixtures.
SCALED = O.QuicLimits(packets=2, attack=0.05, ratio=0.25, acks=7, heavy_acks=3, many=6, some=1)

TRAFFIC = f"""WITH packets AS ({SQL['packets']}),
quic AS (SELECT pkt_id, ts, w, pkt_len, coalesce(dst_port IN (443, 8443), false) AS inbound, src_ip AS client, coalesce(dst_port IN (443, 8443), false) AND net = 'attack' AS attack, pkt_id % 3 = 0 AS is_long, 1 + (pkt_id // 3) % 4 AS acks
  FROM packets WHERE proto = 17 AND (src_port IN (443, 8443) OR dst_port IN (443, 8443)) AND pkt_id % 3 < 2),
clients AS (SELECT w, client, count(*) AS packets, count(*) FILTER (WHERE is_long) AS long, count(*) FILTER (WHERE NOT is_long) AS short, count(*) FILTER (WHERE attack) AS attack, sum(acks) AS acks, coalesce(sum(acks) FILTER (WHERE inbound), 0) AS acks_in,
  coalesce(sum(pkt_len) FILTER (WHERE inbound), 0) AS bytes_in, coalesce(sum(pkt_len) FILTER (WHERE NOT inbound), 0) AS bytes_out FROM quic GROUP BY w, client),
windows AS (SELECT w, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(long) AS BIGINT) AS long, CAST(sum(short) AS BIGINT) AS short, CAST(sum(attack) AS BIGINT) AS attack, CAST(sum(acks) AS BIGINT) AS acks, CAST(sum(bytes_in) AS BIGINT) AS bytes_in, CAST(sum(bytes_out) AS BIGINT) AS bytes_out,
  round(max(CASE WHEN bytes_in > 0 THEN bytes_out / bytes_in::DOUBLE ELSE 0.0 END), 6) AS max_client_ratio, count(*) FILTER (WHERE acks_in > 0) AS ack_ips, CAST(max(acks_in) AS BIGINT) AS max_acks, count(*) FILTER (WHERE acks_in > {SCALED.heavy_acks}) AS heavy_ackers FROM clients GROUP BY w),
panes AS (SELECT w, CAST(epoch_us(date_trunc('hour', ts)) AS BIGINT) AS pane, count(*) AS n, count(*) FILTER (WHERE attack) AS a, coalesce(sum(pkt_len) FILTER (WHERE inbound), 0) AS i, coalesce(sum(pkt_len) FILTER (WHERE NOT inbound), 0) AS o FROM quic GROUP BY 1, 2),
running AS (SELECT w, pane, CAST(sum(n) OVER p AS BIGINT) AS packets, CAST(sum(a) OVER p AS BIGINT) AS attack, CAST(sum(i) OVER p AS BIGINT) AS bytes_in, CAST(sum(o) OVER p AS BIGINT) AS bytes_out FROM panes WINDOW p AS (PARTITION BY w ORDER BY pane)),
early AS (SELECT *, CASE WHEN bytes_in > 0 THEN bytes_out / bytes_in::DOUBLE ELSE 0.0 END AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY pane) AS k FROM running
  WHERE packets >= {SCALED.packets} AND attack > {SCALED.attack} * packets AND bytes_out > {SCALED.ratio} * bytes_in) x WHERE k = 1)
"""


def quic_traffic(spark: SparkSession, sf: str) -> DataFrame:
    """Packets with a payload; those from a service port to another port come from the server."""
    rows = Q.with_sample_payload(packets(spark, sf).where(c("proto") == T.UDP), F.expr("cast(1 + (pkt_id div 3) % 4 as int)"))
    out = F.coalesce(c("src_port").isin(443, 8443), F.lit(False)) & ~F.coalesce(c("dst_port").isin(443, 8443), F.lit(False))
    return rows.withColumns({"src_ip": F.when(out, c("dst_ip")).otherwise(c("src_ip")), "dst_ip": F.when(out, c("src_ip")).otherwise(c("dst_ip"))})


def quic_windows(spark: SparkSession, sf: str) -> DataFrame:
    return O.window_counters(O.client_counters(O.quic_rows(quic_traffic(spark, sf)), DAY), SCALED.heavy_acks)


def early(spark: SparkSession, sf: str) -> DataFrame:
    rows = O.early_amplification(O.quic_rows(quic_traffic(spark, sf)), SCALED, DAY, "1 hour")
    return rows.withColumn("w", F.date_format(F.timestamp_micros("win"), "yyyy-MM-dd HH:mm:ss"))


@query("agg_quic_counters", TRAFFIC + "SELECT w, packets, long, short, acks, bytes_in, bytes_out, round(CASE WHEN bytes_in > 0 THEN bytes_out / bytes_in::DOUBLE ELSE 0.0 END, 6) AS out_in_ratio, max_client_ratio FROM windows")
def agg_quic_counters(spark, sf):
    return quic_windows(spark, sf).select("w", "packets", "long", "short", "acks", "bytes_in", "bytes_out", "out_in_ratio", "max_client_ratio")


@query("agg_quic_acks_per_ip", TRAFFIC + "SELECT w, ack_ips, max_acks, heavy_ackers FROM windows")
def agg_quic_acks_per_ip(spark, sf):
    """Frames that clients sent, not those that the server sent to them."""
    return quic_windows(spark, sf).select("w", "ack_ips", "max_acks", "heavy_ackers")


RULES = {
    "rule_quic_ack_rate": ("ACK_RATE", "HIGH", f"attack > {SCALED.attack} * packets AND max_acks > {SCALED.acks}"),
    "rule_quic_amplification": ("AMPLIFICATION", "HIGH", f"bytes_out > {SCALED.ratio} * bytes_in"),
    "rule_quic_heavy_ackers": ("HEAVY_ACKERS", "MEDIUM", f"heavy_ackers > {SCALED.many} OR (heavy_ackers > {SCALED.some} AND attack > 0)"),
}


def add(name: str, rule: str, severity: str, text: str) -> None:
    @query(name, TRAFFIC + f"SELECT w, {text} AS fired, CASE WHEN {text} THEN '{severity}' ELSE 'NONE' END AS alert_level FROM windows")
    def fired(spark, sf):
        rows = R.evaluate(quic_windows(spark, sf), [r for r in O.window_rules(SCALED) if r.name == rule])
        return rows.select("w", (c("alert_code") > 0).alias("fired"), "alert_level")

    fired.__name__ = name


for _name, _rule in RULES.items():
    add(_name, *_rule)


@query("rule_quic_early", TRAFFIC + "SELECT w, pane, packets, attack, bytes_in, bytes_out, round(ratio, 6) AS ratio, 'HIGH' AS alert_level FROM early")
def rule_quic_early(spark, sf):
    """The first tick inside a window at which packets, attack share and amplification are over their limits, and its figures."""
    return early(spark, sf).select("w", "pane", "packets", "attack", "bytes_in", "bytes_out", "ratio", F.lit("HIGH").alias("alert_level"))


@query("quic_rfc_margin", TRAFFIC + "SELECT w, round(3.0 - ratio, 6) AS margin, round((3.0 - ratio) / 3.0 * 100, 6) AS saved_pct, round((bytes_in + bytes_out) / 1048576.0::DOUBLE, 9) AS mb FROM early")
def quic_rfc_margin(spark, sf):
    """At detection: how far below the protocol's limit, the share of traffic saved, and megabytes seen."""
    return early(spark, sf).select("w", "margin", "saved_pct", "mb")
