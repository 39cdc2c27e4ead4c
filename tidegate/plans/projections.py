"""Projections, filters and predicates over packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.functions import traffic as T
from tidegate.operators import counters as K
from tidegate.plans.registry import query
from tidegate.sources.tables import http_requests, packets, sql

c = F.col
PROTO_SQL = "CASE proto WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' ELSE 'other' END"


@query("flt_ipv4", sql("SELECT pkt_id, proto FROM packets WHERE proto IN (1, 6, 17)"))
def flt_ipv4(spark, sf):
    rows = packets(spark, sf).withColumn("eth_type", F.when(c("proto").isin(T.ICMP, T.TCP, T.UDP), 0x0800).otherwise(0x86DD))
    return rows.where(c("eth_type") == 0x0800).select("pkt_id", "proto")


@query("proj_protocol", sql(f"SELECT pkt_id, {PROTO_SQL} AS protocol FROM packets"))
def proj_protocol(spark, sf):
    return packets(spark, sf).select("pkt_id", T.protocol_name(c("proto")).alias("protocol"))


@query("proj_tcp_flags", sql("SELECT pkt_id, coalesce(tcp_flags & 2 <> 0, false) AS syn, coalesce(tcp_flags & 16 <> 0, false) AS ack, coalesce(tcp_flags & 4 <> 0, false) AS rst, coalesce(tcp_flags & 1 <> 0, false) AS fin FROM packets"))
def proj_tcp_flags(spark, sf):
    f = c("tcp_flags")
    return packets(spark, sf).select("pkt_id", T.has_flag(f, T.SYN).alias("syn"), T.has_flag(f, T.ACK).alias("ack"), T.has_flag(f, T.RST).alias("rst"), T.has_flag(f, T.FIN).alias("fin"))


@query("proj_syn_ack", sql("SELECT pkt_id, coalesce(tcp_flags & 18 = 18, false) AS syn_ack FROM packets"))
def proj_syn_ack(spark, sf):
    return packets(spark, sf).select("pkt_id", T.is_syn_ack(c("tcp_flags")).alias("syn_ack"))


@query("proj_pure_ack", sql("SELECT pkt_id, coalesce(tcp_flags = 16, false) AS pure_ack FROM packets"))
def proj_pure_ack(spark, sf):
    return packets(spark, sf).select("pkt_id", T.is_pure_ack(c("tcp_flags")).alias("pure_ack"))


@query("proj_fragmented", sql("SELECT pkt_id, frag_off & 16383 <> 0 AS fragmented FROM packets"))
def proj_fragmented(spark, sf):
    return packets(spark, sf).select("pkt_id", T.is_fragment(c("frag_off")).alias("fragmented"))


@query("proj_small_pkt", sql("SELECT pkt_id, pkt_len < 100 AS small FROM packets"))
def proj_small_pkt(spark, sf):
    return packets(spark, sf).select("pkt_id", T.is_small(c("pkt_len")).alias("small"))


SERVICE_SQL = """CASE WHEN proto = 6 AND dst_port = 80 THEN 'http' WHEN proto = 6 AND dst_port = 22 THEN 'ssh' WHEN proto = 17 AND (src_port = 53 OR dst_port = 53) THEN 'dns'
  WHEN proto = 17 AND (src_port = 123 OR dst_port = 123) THEN 'ntp' WHEN proto = 17 AND (src_port IN (443, 8443) OR dst_port IN (443, 8443)) THEN 'quic' ELSE 'other' END"""


@query("proj_service", sql(f"SELECT pkt_id, {SERVICE_SQL} AS service FROM packets"))
def proj_service(spark, sf):
    return packets(spark, sf).select("pkt_id", T.service_name(c("proto"), c("src_port"), c("dst_port")).alias("service"))


@query("proj_net_class", sql("SELECT pkt_id, net AS net_class FROM packets"))
def proj_net_class(spark, sf):
    return packets(spark, sf).select("pkt_id", T.network_class(c("src_ip")).alias("net_class"))


@query("flt_server_ip", sql("SELECT pkt_id, src_ip FROM packets WHERE src_ip <> 168427778"))
def flt_server_ip(spark, sf):
    return packets(spark, sf).where(c("src_ip") != T.SERVER_IP).select("pkt_id", "src_ip")


@query("proj_direction", sql("SELECT pkt_id, CASE WHEN dst_port IN (443, 8443) THEN 'in' ELSE 'out' END AS direction FROM packets WHERE proto = 17"))
def proj_direction(spark, sf):
    return packets(spark, sf).where(c("proto") == T.UDP).select("pkt_id", T.direction(c("dst_port")).alias("direction"))


@query("flt_min_payload", sql("SELECT pkt_id, length(payload) AS payload_len FROM http_requests WHERE length(payload) >= 10", "packets", "http_requests"))
def flt_min_payload(spark, sf):
    return http_requests(spark, sf).select("pkt_id", F.length("payload").cast("long").alias("payload_len")).where("payload_len >= 10")


@query("flt_zero_traffic", sql("SELECT w, http FROM counters WHERE http > 0", "counters"))
def flt_zero_traffic(spark, sf):
    return K.window_counters(packets(spark, sf), "1 day", only=("http",)).where("http > 0")


@query("gate_min_packets", sql("SELECT w, packets FROM counters WHERE packets >= 330", "counters"))
def gate_min_packets(spark, sf):
    return K.window_counters(packets(spark, sf), "1 day", only=("packets",)).where("packets >= 330")


@query("sample_1_in_n", sql("SELECT pkt_id, 32 AS weight FROM packets WHERE net = 'attack' AND pkt_id % 32 = 0"))
def sample_1_in_n(spark, sf):
    return packets(spark, sf).where((T.network_class(c("src_ip")) == "attack") & (c("pkt_id") % 32 == 0)).select("pkt_id", F.lit(32).alias("weight"))
