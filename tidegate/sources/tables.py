"""Packet, request and snapshot tables as views of the given tables, in Spark and as SQL text for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions import traffic as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets_of(events: DataFrame) -> DataFrame:
    """Packet rows from event rows: pkt_id, ts, src_ip, dst_ip, proto, pkt_len, src_port, dst_port, tcp_flags, frag_off."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    kind, user = F.col("event_type"), F.col("user_id")
    udp = kind == "error"
    source = F.when(kind == "signup", None).when(udp & (k % 11 == 0), 443).when(udp & (k % 7 == 0), 53).otherwise(1024 + k * 37)
    pick = lambda names: F.get(F.array(*[F.lit(p) for p in names]), k % 5)
    target = F.when(kind == "signup", None).when(udp, pick((53, 123, 443, 8443, 161))).otherwise(pick((80, 80, 443, 8080, 22)))
    flags = F.when(kind.isin("error", "signup"), None).when(k % 10 == 0, 4).when(k % 10 == 1, 17).when(k % 10 == 2, 18).when(kind == "click", 2).when(kind == "view", 16).otherwise(24)
    return events.select(
        F.col("event_id").alias("pkt_id"), "ts",
        (F.when(user % 4 == 0, F.lit(168428032)).otherwise(F.lit(168427776)) + user % 254 + 1).cast("long").alias("src_ip"),
        F.lit(T.SERVER_IP).cast("long").alias("dst_ip"),
        F.when(udp, T.UDP).when(kind == "signup", T.ICMP).otherwise(T.TCP).alias("proto"),
        (60 + F.floor(F.col("value") * 3).cast("int")).alias("pkt_len"), source.cast("int").alias("src_port"), target.cast("int").alias("dst_port"),
        flags.cast("int").alias("tcp_flags"), F.when(k % 20 == 0, 8192).when(k % 20 == 1, 185).otherwise(16384).alias("frag_off"),
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_of(table(spark, sf_dir, "events"))


def http_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to port 80 with their full text: pkt_id, ts, src_ip, pkt_len, payload."""
    p, g = packets(spark, sf_dir), table(spark, sf_dir, "pages")
    agent = lambda text: F.lit(f"User-Agent: {text}\r\n")
    six = F.col("pkt_id") % 6
    agents = F.when(six == 0, "").when(six == 1, agent("curl/7.68.0")).when(six == 2, agent("Mozilla/5.0 Firefox/95.0")).when(six == 3, agent("Mozilla/5.0 Safari/605.1")).otherwise(agent("Mozilla/5.0 Chrome/96.0 Safari/537.36"))
    # Pages by number, so that the packets go round all of them: as many keys as pages, none of them hot.
    number = F.broadcast(g.agg(F.count("*").alias("pages")))  # one row
    rows = p.where((F.col("proto") == T.TCP) & (F.col("dst_port") == 80)).crossJoin(number).join(g, F.col("page_id") == F.col("pkt_id") % F.col("pages"))
    method = F.when(F.col("pkt_id") % 5 == 0, "POST").otherwise("GET")
    text = F.concat(method, F.lit(" "), F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1), F.lit(" HTTP/1.1\r\nHost: "), F.regexp_extract("url", "^https?://([^/]+)", 1), F.lit("\r\n"), agents, F.lit("\r\n"))
    return rows.select("pkt_id", "ts", "src_ip", "pkt_len", text.alias("payload"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counters of one run, a row for each interval (here a day), the attack starting on the eleventh."""
    from pyspark.sql import Window

    p = packets(spark, sf_dir)
    net = T.network_class(F.col("src_ip"))
    daily = (
        p.where(~((net == "attack") & (F.col("ts") < F.lit("2024-01-11 00:00:00").cast("timestamp_ntz"))))
        .groupBy(F.date_trunc("day", "ts").alias("day"))
        .agg(F.count("*").alias("w_tot"), F.sum("pkt_len").alias("w_bytes"), T.count_where(net == "baseline").alias("w_base"), T.count_where(net == "attack").alias("w_att"), T.count_where(T.has_flag(F.col("tcp_flags"), T.SYN)).alias("w_syn"), T.count_where(F.col("proto") == T.TCP).alias("w_tcp"))
        .withColumn("run_id", F.lit("r1"))
    )
    # A row for each interval: small, whatever the number of packets.
    w = Window.partitionBy("run_id").orderBy("day")
    c = F.col
    level = F.when(c("w_att") * 100 > c("w_tot") * 26, "HIGH").when(c("w_att") * 100 > c("w_tot") * 22, "MEDIUM").when(c("w_syn") * 100 > c("w_tcp") * 36, "LOW").otherwise("NONE")
    rows = daily.select("run_id", F.row_number().over(w).alias("idx"), F.sum("w_tot").over(w).alias("total_packets"), F.sum("w_base").over(w).alias("baseline_packets"), F.sum("w_att").over(w).alias("attack_packets"), F.sum("w_bytes").over(w).alias("total_bytes"), level.alias("alert_level"))
    return rows.select("run_id", "idx", (c("idx") * 5).alias("interval_s"), "total_packets", "baseline_packets", "attack_packets", "total_bytes", F.round(100 * c("attack_packets").cast("double") / c("total_packets"), 1).alias("attack_percent"), "alert_level")


SQL = {
    "packets": """SELECT event_id AS pkt_id, ts,
  CAST(CASE WHEN user_id % 4 = 0 THEN 168428032 ELSE 168427776 END + (user_id % 254) + 1 AS BIGINT) AS src_ip, CAST(168427778 AS BIGINT) AS dst_ip,
  CASE event_type WHEN 'error' THEN 17 WHEN 'signup' THEN 1 ELSE 6 END AS proto, 60 + CAST(floor(value * 3) AS INT) AS pkt_len,
  CASE WHEN event_type = 'signup' THEN NULL WHEN event_type = 'error' AND k % 11 = 0 THEN 443 WHEN event_type = 'error' AND k % 7 = 0 THEN 53 ELSE 1024 + k * 37 END AS src_port,
  CASE WHEN event_type = 'signup' THEN NULL WHEN event_type = 'error' THEN CASE k % 5 WHEN 0 THEN 53 WHEN 1 THEN 123 WHEN 2 THEN 443 WHEN 3 THEN 8443 ELSE 161 END
    ELSE CASE k % 5 WHEN 0 THEN 80 WHEN 1 THEN 80 WHEN 2 THEN 443 WHEN 3 THEN 8080 ELSE 22 END END AS dst_port,
  CASE WHEN event_type IN ('error', 'signup') THEN NULL WHEN k % 10 = 0 THEN 4 WHEN k % 10 = 1 THEN 17 WHEN k % 10 = 2 THEN 18 WHEN event_type = 'click' THEN 2 WHEN event_type = 'view' THEN 16 ELSE 24 END AS tcp_flags,
  CASE k % 20 WHEN 0 THEN 8192 WHEN 1 THEN 185 ELSE 16384 END AS frag_off,
  CASE WHEN user_id % 4 = 0 THEN 'attack' ELSE 'baseline' END AS net, strftime(ts, '%Y-%m-%d 00:00:00') AS w
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e""",
    "http_requests": """SELECT p.pkt_id, p.ts, p.w, p.src_ip, p.net, p.pkt_len,
  concat(CASE WHEN p.pkt_id % 5 = 0 THEN 'POST' ELSE 'GET' END, ' ', regexp_extract(g.url, '^https?://[^/]+(/[^?#]*)', 1), ' HTTP/1.1', chr(13), chr(10), 'Host: ', regexp_extract(g.url, '^https?://([^/]+)', 1), chr(13), chr(10),
    CASE p.pkt_id % 6 WHEN 0 THEN '' WHEN 1 THEN concat('User-Agent: curl/7.68.0', chr(13), chr(10)) WHEN 2 THEN concat('User-Agent: Mozilla/5.0 Firefox/95.0', chr(13), chr(10))
      WHEN 3 THEN concat('User-Agent: Mozilla/5.0 Safari/605.1', chr(13), chr(10)) ELSE concat('User-Agent: Mozilla/5.0 Chrome/96.0 Safari/537.36', chr(13), chr(10)) END, chr(13), chr(10)) AS payload
FROM packets p JOIN pages g ON g.page_id = p.pkt_id % (SELECT count(*) FROM pages) WHERE p.proto = 6 AND p.dst_port = 80""",
    "snapshots": """SELECT 'r1' AS run_id, idx, idx * 5 AS interval_s, total_packets, baseline_packets, attack_packets, total_bytes,
  round(CAST(100 * attack_packets AS DOUBLE) / total_packets, 1) AS attack_percent,
  CASE WHEN w_att * 100 > w_tot * 26 THEN 'HIGH' WHEN w_att * 100 > w_tot * 22 THEN 'MEDIUM' WHEN w_syn * 100 > w_tcp * 36 THEN 'LOW' ELSE 'NONE' END AS alert_level
FROM (SELECT CAST(row_number() OVER (ORDER BY day) AS INT) AS idx, w_tot, w_att, w_syn, w_tcp, CAST(sum(w_tot) OVER (ORDER BY day) AS BIGINT) AS total_packets, CAST(sum(w_base) OVER (ORDER BY day) AS BIGINT) AS baseline_packets,
    CAST(sum(w_att) OVER (ORDER BY day) AS BIGINT) AS attack_packets, CAST(sum(w_bytes) OVER (ORDER BY day) AS BIGINT) AS total_bytes
  FROM (SELECT date_trunc('day', ts) AS day, count(*) AS w_tot, sum(pkt_len) AS w_bytes, sum(CASE WHEN net = 'baseline' THEN 1 ELSE 0 END) AS w_base, sum(CASE WHEN net = 'attack' THEN 1 ELSE 0 END) AS w_att,
      sum(CASE WHEN (tcp_flags & 2) <> 0 THEN 1 ELSE 0 END) AS w_syn, sum(CASE WHEN proto = 6 THEN 1 ELSE 0 END) AS w_tcp
    FROM packets WHERE NOT (net = 'attack' AND ts < TIMESTAMP '2024-01-11 00:00:00') GROUP BY 1) d) s""",
}
SQL["counters"] = """SELECT w, CAST(count(*) AS BIGINT) AS packets, CAST(sum(pkt_len) AS BIGINT) AS bytes,
  CAST(count(*) FILTER (WHERE proto = 6) AS BIGINT) AS tcp, CAST(count(*) FILTER (WHERE proto = 17) AS BIGINT) AS udp, CAST(count(*) FILTER (WHERE proto = 1) AS BIGINT) AS icmp,
  CAST(count(*) FILTER (WHERE tcp_flags & 2 <> 0) AS BIGINT) AS syn, CAST(count(*) FILTER (WHERE tcp_flags & 16 <> 0) AS BIGINT) AS ack, CAST(count(*) FILTER (WHERE tcp_flags & 4 <> 0) AS BIGINT) AS rst,
  CAST(count(*) FILTER (WHERE tcp_flags & 1 <> 0) AS BIGINT) AS fin, CAST(count(*) FILTER (WHERE tcp_flags & 8 <> 0) AS BIGINT) AS psh, CAST(count(*) FILTER (WHERE tcp_flags & 18 = 18) AS BIGINT) AS syn_ack,
  CAST(count(*) FILTER (WHERE frag_off & 16383 <> 0) AS BIGINT) AS frag, CAST(count(*) FILTER (WHERE pkt_len < 100) AS BIGINT) AS small,
  CAST(count(*) FILTER (WHERE proto = 6 AND dst_port = 80) AS BIGINT) AS http, CAST(count(*) FILTER (WHERE proto = 17 AND (src_port = 53 OR dst_port = 53)) AS BIGINT) AS dns,
  CAST(count(*) FILTER (WHERE net = 'baseline') AS BIGINT) AS baseline, CAST(count(*) FILTER (WHERE net = 'attack') AS BIGINT) AS attack
FROM packets GROUP BY w"""


def sql(body: str, *names: str) -> str:
    """A query with the named views before it, in order of need."""
    order = ["packets", *names] if "packets" not in names else list(names)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n" + body
