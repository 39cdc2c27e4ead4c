"""Scalar functions over packet, request and snapshot rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.functions import traffic as T
from tidegate.operators import counters as K
from tidegate.plans.registry import query
from tidegate.sources.tables import http_requests, packets, snapshots, sql

c = F.col
IP_SQL = "concat_ws('.', (src_ip >> 24) & 255, (src_ip >> 16) & 255, (src_ip >> 8) & 255, src_ip & 255)"


@query("fn_ip_to_string", sql(f"SELECT pkt_id, {IP_SQL} AS ip FROM packets"))
def fn_ip_to_string(spark, sf):
    return packets(spark, sf).select("pkt_id", T.ip_to_string(c("src_ip")).alias("ip"))


@query("fn_string_to_ip", sql("SELECT pkt_id, src_ip AS ip FROM packets"))
def fn_string_to_ip(spark, sf):
    return packets(spark, sf).select("pkt_id", T.string_to_ip(T.ip_to_string(c("src_ip"))).alias("ip"))


M32 = "& 4294967295"


def jenkins_sql() -> str:
    h = "CAST(0 AS BIGINT)"
    steps = []
    for i, s in enumerate((24, 16, 8, 0)):
        steps.append(f"a{i} AS (SELECT pkt_id, src_ip, (h + ((src_ip >> {s}) & 255)) {M32} AS h FROM {'b' + str(i - 1) if i else 'start'}), m{i} AS (SELECT pkt_id, src_ip, (h + h * 1024) {M32} AS h FROM a{i}), b{i} AS (SELECT pkt_id, src_ip, xor(h, h >> 6) AS h FROM m{i})")
    return f"start AS (SELECT pkt_id, src_ip, {h} AS h FROM packets), " + ", ".join(steps) + f", t1 AS (SELECT pkt_id, (h + h * 8) {M32} AS h FROM b3), t2 AS (SELECT pkt_id, xor(h, h >> 11) AS h FROM t1) SELECT pkt_id, (h + h * 32768) {M32} AS h FROM t2"


@query("fn_hash_jenkins", sql("SELECT 1").rsplit("SELECT 1", 1)[0].rstrip() + ", " + jenkins_sql())
def fn_hash_jenkins(spark, sf):
    parts = [F.shiftright(c("src_ip"), s).bitwiseAND(255) for s in (24, 16, 8, 0)]
    rows = packets(spark, sf)
    # Each round is a column of its own, so that the expression stays small.
    h = F.lit(0).cast("long")
    for i, b in enumerate(parts):
        rows = rows.withColumn(f"h{i}", (h + b).bitwiseAND(0xFFFFFFFF))
        rows = rows.withColumn(f"g{i}", (c(f"h{i}") + F.shiftleft(c(f"h{i}"), 10)).bitwiseAND(0xFFFFFFFF))
        rows = rows.withColumn(f"f{i}", c(f"g{i}").bitwiseXOR(F.shiftright(c(f"g{i}"), 6)))
        h = c(f"f{i}")
    rows = rows.withColumn("x", (h + F.shiftleft(h, 3)).bitwiseAND(0xFFFFFFFF)).withColumn("y", c("x").bitwiseXOR(F.shiftright(c("x"), 11)))
    return rows.select("pkt_id", (c("y") + F.shiftleft(c("y"), 15)).bitwiseAND(0xFFFFFFFF).alias("h"))


@query("fn_hash_murmur", sql(f"""SELECT pkt_id, CAST(xor(CAST(2538058376::HUGEINT * 1540483477 {M32} AS BIGINT), CAST(CAST(xor(k, k >> 24) AS HUGEINT) * 1540483477 {M32} AS BIGINT)) AS BIGINT) AS h
  FROM (SELECT pkt_id, CAST(CAST(src_ip AS HUGEINT) * 1540483477 {M32} AS BIGINT) AS k FROM packets) s"""))
def fn_hash_murmur(spark, sf):
    return packets(spark, sf).select("pkt_id", T.murmur_body(c("src_ip")).alias("h"))


@query("fn_clz", sql("SELECT pkt_id, CAST(32 - length(ltrim(bin(src_ip), '0')) AS INT) AS zeros FROM packets"))
def fn_clz(spark, sf):
    return packets(spark, sf).select("pkt_id", T.leading_zeros(c("src_ip")).alias("zeros"))


@query("fn_pps_to_gbps", sql("SELECT w, round(packets / 86400.0::DOUBLE * 700 * 8 / 1e9, 9) AS gbps FROM counters", "counters"))
def fn_pps_to_gbps(spark, sf):
    return K.window_counters(packets(spark, sf), "1 day", only=("packets",)).select("w", F.round(T.gbps(c("packets") / 86400.0), 9).alias("gbps"))


@query("fn_link_util", sql("SELECT w, round(bytes * 8 / 1e9 / 25.0 * 100, 9) AS util FROM counters", "counters"))
def fn_link_util(spark, sf):
    return K.window_counters(packets(spark, sf), "1 day", only=("bytes",)).select("w", F.round(T.link_utilisation(c("bytes") * 8 / 1e9), 9).alias("util"))


REQUEST_SQL = "SELECT pkt_id, w, src_ip, net, split_part(payload, ' ', 1) AS method, left(split_part(payload, ' ', 2), 255) AS path, regexp_extract(payload, 'Host: ([^\\r\\n]*)', 1) AS host, regexp_extract(payload, 'User-Agent: ([^\\r\\n]*)', 1) AS agent FROM http_requests"


@query("fn_http_request", sql(f"SELECT pkt_id, method, path, host, agent FROM ({REQUEST_SQL}) r", "packets", "http_requests"))
def fn_http_request(spark, sf):
    p = c("payload")
    return http_requests(spark, sf).select("pkt_id", T.request_method(p).alias("method"), T.request_path(p).alias("path"), T.request_header(p, "Host").alias("host"), T.request_header(p, "User-Agent").alias("agent"))


@query("fn_ua_family", sql(f"SELECT pkt_id, CASE WHEN contains(agent, 'Chrome') THEN 'Chrome' WHEN contains(agent, 'Firefox') THEN 'Firefox' WHEN contains(agent, 'Safari') THEN 'Safari' ELSE 'Other' END AS family FROM ({REQUEST_SQL}) r", "packets", "http_requests"))
def fn_ua_family(spark, sf):
    return http_requests(spark, sf).select("pkt_id", T.agent_family(T.request_header(c("payload"), "User-Agent")).alias("family"))


@query("fn_url_category", """SELECT page_id, CASE WHEN p IN ('/', '/index.html') THEN 'Homepage' WHEN contains(lower(p), '/api') THEN 'API' WHEN regexp_matches(lower(p), '\\.(css|js|png|jpg|jpeg|gif|ico|svg|woff2?)$') THEN 'Static'
  WHEN regexp_matches(lower(p), '\\.(php|asp|aspx|jsp|html?)$') THEN 'Dynamic' WHEN regexp_matches(lower(p), '(ws|socket|stream|live)') THEN 'Realtime' ELSE 'Other' END AS category
FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS p FROM pages) s""")
def fn_url_category(spark, sf):
    from tidegate.sources.tables import table

    return table(spark, sf, "pages").select("page_id", T.url_category(F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1)).alias("category"))


@query("fn_strip_ansi", sql("SELECT pkt_id, concat('len ', pkt_len) AS text FROM packets"))
def fn_strip_ansi(spark, sf):
    coloured = F.concat(F.lit("\x1b[1;31mlen \x1b[0m"), c("pkt_len").cast("string"), F.lit("\x1b[K"))
    return packets(spark, sf).select("pkt_id", T.strip_ansi(coloured).alias("text"))


@query("fn_extract_number", sql("SELECT pkt_id, CASE WHEN pkt_id % 4 = 3 THEN 0 ELSE CAST(src_ip AS DOUBLE) END AS value, CASE WHEN pkt_id % 4 = 3 THEN 0 ELSE src_ip END AS whole FROM packets"))
def fn_extract_number(spark, sf):
    """The first group as a number; 0 where the text has no match or no number there."""
    line = F.when(c("pkt_id") % 4 == 3, "Total: none pkts").otherwise(F.concat(F.lit("Total: "), F.format_number("src_ip", 0), F.lit(" pkts")))
    return packets(spark, sf).select("pkt_id", T.extract_number(line, r"Total:\s+([0-9,.]+)").alias("value"), T.extract_number(line, r"Total:\s+([0-9,.]+)", "long").alias("whole"))


#: Limits of the bands of the ratio of SYN to ACK: the documented ones, and such as the fixtures reach.
SYN_ACK_BANDS, SYN_ACK_SCALED = (1.0, 3.0, 5.0), (0.4, 0.5, 0.6)
SMOOTHED = "CASE WHEN ack > 10 THEN syn / (ack + 1)::DOUBLE ELSE 0.0 END"


def syn_ack_sql(limits):
    low, mid, high = limits
    return f"CASE WHEN {SMOOTHED} > {high} THEN 'attack' WHEN {SMOOTHED} > {mid} THEN 'suspicious' WHEN {SMOOTHED} > {low} THEN 'elevated' ELSE 'normal' END"


@query("fn_syn_ack_smoothed", sql(f"SELECT w, round({SMOOTHED}, 6) AS smoothed, {syn_ack_sql(SYN_ACK_BANDS)} AS band, {syn_ack_sql(SYN_ACK_SCALED)} AS scaled_band FROM counters", "counters"))
def fn_syn_ack_smoothed(spark, sf):
    rows = K.window_counters(packets(spark, sf), "1 day", only=("syn", "ack")).withColumn("v", T.syn_ack_smoothed(c("syn"), c("ack")))
    return rows.select("w", F.round("v", 6).alias("smoothed"), T.syn_ack_band(c("v"), SYN_ACK_BANDS).alias("band"), T.syn_ack_band(c("v"), SYN_ACK_SCALED).alias("scaled_band"))


@query("fn_band", sql("SELECT run_id, idx, CASE WHEN attack_percent > 15 THEN 'high' WHEN attack_percent > 0 THEN 'medium' ELSE 'low' END AS band FROM snapshots", "packets", "snapshots"))
def fn_band(spark, sf):
    return snapshots(spark, sf).select("run_id", "idx", T.band(c("attack_percent"), 0, 15).alias("band"))


@query("fn_zscore", sql("SELECT w, round((packets - avg(packets) OVER ()) / (stddev_pop(packets) OVER () + 1e-8), 4) AS pps_z, round((syn - avg(syn) OVER ()) / (stddev_pop(syn) OVER () + 1e-8), 4) AS syn_z FROM counters", "counters"))
def fn_zscore(spark, sf):
    from tidegate.operators.models import zscores

    rows = K.window_counters(packets(spark, sf), "1 day", only=("packets", "syn"))
    return zscores(rows, {"packets": "pps_z", "syn": "syn_z"}).select("w", F.round("pps_z", 4).alias("pps_z"), F.round("syn_z", 4).alias("syn_z"))


@query("fn_rescale_time", sql("SELECT pkt_id, CAST(epoch_us((SELECT min(ts) FROM packets)) + floor((epoch_us(ts) - epoch_us((SELECT min(ts) FROM packets))) / 10.0::DOUBLE) AS BIGINT) AS us FROM packets"))
def fn_rescale_time(spark, sf):
    from tidegate.operators.series import rescale_time

    return rescale_time(packets(spark, sf), 10.0).select("pkt_id", "us")


@query("fn_alert_code", sql("SELECT run_id, idx, alert_level, CAST(CASE alert_level WHEN 'NONE' THEN 0 WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 END AS INT) AS code FROM snapshots", "packets", "snapshots"))
def fn_alert_code(spark, sf):
    code = T.alert_code(c("alert_level"))
    return snapshots(spark, sf).select("run_id", "idx", T.alert_level(code).alias("alert_level"), code.alias("code"))


@query("fn_diurnal_factor", sql("SELECT pkt_id, round(0.6 + 0.4 * sin(2 * pi() * (hour(ts) - 6) / 24), 6) AS factor FROM packets"))
def fn_diurnal_factor(spark, sf):
    return packets(spark, sf).select("pkt_id", F.round(T.diurnal_factor(F.hour("ts")), 6).alias("factor"))


@query("proj_quic_valid", sql("SELECT pkt_id, pkt_id % 3 < 2 AS valid FROM packets WHERE proto = 17"))
def proj_quic_valid(spark, sf):
    from tidegate.functions import quic as Q

    rows = Q.with_sample_payload(packets(spark, sf).where(c("proto") == T.UDP))
    return rows.select("pkt_id", Q.is_valid(c("payload")).alias("valid"))


@query("proj_quic_header", sql("SELECT pkt_id, CASE pkt_id % 3 WHEN 0 THEN 'long' WHEN 1 THEN 'short' ELSE 'none' END AS header FROM packets WHERE proto = 17"))
def proj_quic_header(spark, sf):
    from tidegate.functions import quic as Q

    rows = Q.with_sample_payload(packets(spark, sf).where(c("proto") == T.UDP))
    return rows.select("pkt_id", Q.header_kind(c("payload")).alias("header"))


@query("fn_quic_acks", sql("SELECT pkt_id, CAST(CASE WHEN pkt_id % 3 < 2 THEN 1 ELSE 0 END AS BIGINT) AS acks, CASE WHEN pkt_id % 3 < 2 THEN pkt_id END AS largest FROM packets WHERE proto = 17"))
def fn_quic_acks(spark, sf):
    from tidegate.functions import quic as Q

    rows = Q.with_sample_payload(packets(spark, sf).where(c("proto") == T.UDP))
    return Q.ack_frames(rows.select("pkt_id", "payload"))
