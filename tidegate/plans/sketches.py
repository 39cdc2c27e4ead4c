"""Sketches, heavy hitters and entropy."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegate.functions import traffic as T
from tidegate.operators import blocks as B
from tidegate.operators import counters as K
from tidegate.operators import sketches as S
from tidegate.plans.registry import query
from tidegate.sources.tables import http_requests, packets, sql

c = F.col
DAY = "1 day"
DEPTH, WIDTH = 4, 256


def cms_sql(keys: str = "", where: str = "TRUE") -> str:
    head = f"{keys}, " if keys else ""
    parts = " UNION ALL ".join(f"SELECT {head}{i} AS row, {S.hash_sql('src_ip', i)} % {WIDTH} AS bucket FROM packets WHERE {where}" for i in range(DEPTH))
    return f"SELECT {head}row, bucket, count(*) AS cnt FROM ({parts}) x GROUP BY ALL"


@query("cms_build", sql(cms_sql()))
def cms_build(spark, sf):
    return S.cms_build(packets(spark, sf), "src_ip", DEPTH, WIDTH)


@query("cms_query", sql(f"SELECT src_ip, CAST(min(cnt) AS BIGINT) AS estimate FROM (" + " UNION ALL ".join(f"SELECT DISTINCT src_ip, {i} AS row, {S.hash_sql('src_ip', i)} % {WIDTH} AS bucket FROM packets" for i in range(DEPTH)) + f") k JOIN ({cms_sql()}) s USING (row, bucket) GROUP BY src_ip"))
def cms_query(spark, sf):
    p = packets(spark, sf)
    return S.cms_query(S.cms_build(p, "src_ip", DEPTH, WIDTH), p.select("src_ip").distinct(), "src_ip", DEPTH, WIDTH)


@query("cms_merge", sql(cms_sql()))
def cms_merge(spark, sf):
    p = packets(spark, sf)
    parts = [S.cms_build(p.where(c("pkt_id") % 4 == i), "src_ip", DEPTH, WIDTH) for i in range(4)]
    return S.cms_merge(*parts)


@query("cms_window_reset", sql(cms_sql("w")))
def cms_window_reset(spark, sf):
    return S.cms_build(packets(spark, sf).withColumn("w", K.window_start(DAY)), "src_ip", DEPTH, WIDTH, keys=("w",)).transform(K.named)


@query("cms_error", sql("SELECT src_ip, count(*) AS exact, true AS never_under, true AS within_bound FROM packets GROUP BY src_ip"))
def cms_error(spark, sf):
    p = packets(spark, sf)
    exact = p.groupBy("src_ip").agg(F.count("*").alias("exact"))
    total = F.broadcast(p.agg(F.count("*").alias("total")))  # one row
    rows = S.cms_query(S.cms_build(p, "src_ip", DEPTH, 2048), p.select("src_ip").distinct(), "src_ip", DEPTH, 2048).join(exact, "src_ip").crossJoin(total)
    return rows.select("src_ip", "exact", (c("estimate") >= c("exact")).alias("never_under"), (c("estimate") - c("exact") <= S.cms_bound(c("total"))).alias("within_bound"))


@query("sketch_sampled_estimate", sql("SELECT w, CAST(count(*) FILTER (WHERE pkt_id % 4 = 0) * 4 AS BIGINT) AS est_packets, CAST(coalesce(sum(pkt_len) FILTER (WHERE pkt_id % 4 = 0), 0) * 4 AS BIGINT) AS est_bytes, count(*) AS exact FROM packets GROUP BY w"))
def sketch_sampled_estimate(spark, sf):
    kept = c("pkt_id") % 4 == 0
    return packets(spark, sf).groupBy(K.window_start(DAY).alias("w")).agg((T.count_where(kept) * 4).alias("est_packets"), (F.sum(F.when(kept, c("pkt_len")).otherwise(0)) * 4).alias("est_bytes"), F.count("*").alias("exact")).transform(K.named)


BITS = 10
HLL_HASH = f"({S.hash_sql(S.fifth_power_sql(S.hash_sql('src_ip', 0)), 4)} % 2147483648)"
HLL_SQL = f"SELECT h >> 21 AS idx, CAST(max(CASE WHEN h & 2097151 = 0 THEN 22 ELSE 21 - length(ltrim(bin(h & 2097151), '0')) + 1 END) AS INT) AS rho FROM (SELECT {HLL_HASH} AS h FROM packets) x GROUP BY 1"


@query("hll_registers", sql(HLL_SQL))
def hll_registers(spark, sf):
    return S.hll_registers(packets(spark, sf), "src_ip", BITS)


ALPHA = 0.7213 / (1 + 1.079 / 1024)


@query("hll_estimate", sql(f"SELECT round(CASE WHEN raw <= 2560 AND e > 0 THEN 1024 * ln(1024.0::DOUBLE / e) ELSE raw END, 4) AS estimate FROM (SELECT {ALPHA!r}::DOUBLE * 1024 * 1024 / (sum(pow(2.0, -rho)) + (1024 - count(*))) AS raw, 1024 - count(*) AS e FROM ({HLL_SQL}) r) s"))
def hll_estimate(spark, sf):
    return S.hll_estimate(S.hll_registers(packets(spark, sf), "src_ip", BITS), BITS)


@query("hll_distinct", sql("SELECT w, count(DISTINCT src_ip) AS exact, true AS within_bound FROM packets GROUP BY w"))
def hll_distinct(spark, sf):
    rows = packets(spark, sf).groupBy(K.window_start(DAY).alias("w")).agg(F.hll_sketch_estimate(F.hll_sketch_agg("src_ip", F.lit(12))).alias("estimate")).transform(K.named)
    exact = K.key_counts(packets(spark, sf), "src_ip", DAY).groupBy("w").agg(F.count("*").alias("exact"))
    return rows.join(exact, "w").select("w", "exact", (F.abs(c("estimate") - c("exact")) <= F.greatest(F.lit(2), c("exact") * 0.05)).alias("within_bound"))


@query("hll_running_distinct", sql("SELECT w, CAST(sum(n) OVER (ORDER BY w) AS BIGINT) AS exact, true AS within_bound FROM (SELECT w, count(DISTINCT src_ip) FILTER (WHERE w = f) AS n FROM packets JOIN (SELECT src_ip, min(w) AS f FROM packets GROUP BY src_ip) s USING (src_ip) GROUP BY w) x"))
def hll_running_distinct(spark, sf):
    """Sketches of days, united along the run block by block."""
    p = packets(spark, sf)
    week = F.floor(F.unix_timestamp("w", "yyyy-MM-dd HH:mm:ss") / (7 * 86400))
    daily = p.groupBy(K.window_start(DAY).alias("w")).agg(F.hll_sketch_agg("src_ip", F.lit(12)).alias("sketch")).transform(K.named)
    first = p.groupBy("src_ip").agg(F.min(F.date_trunc("day", "ts")).alias("d")).groupBy(F.date_format("d", "yyyy-MM-dd HH:mm:ss").alias("w")).agg(F.count("*").alias("n"))
    rows = daily.join(first, "w", "left")
    found = B.running(rows, "w", week, {"all": B.union_of_sketches(c("sketch")), "exact": B.Scan(F.coalesce("n", F.lit(0)))})
    return found.select("w", "exact", (F.abs(F.hll_sketch_estimate("all") - c("exact")) <= F.greatest(F.lit(2), c("exact") * 0.05)).alias("within_bound"))


@query("bloom_membership", sql("SELECT DISTINCT src_ip, src_ip IN (SELECT src_ip FROM packets WHERE ts < TIMESTAMP '2024-01-03') AS member, true AS no_false_negative FROM packets"))
def bloom_membership(spark, sf):
    p = packets(spark, sf)
    early = p.where("ts < timestamp_ntz'2024-01-03'").select("src_ip").distinct()
    maybe = S.bloom_member(p, S.bloom_build(early, "src_ip"), "src_ip")
    rows = maybe.join(early.withColumn("in_set", F.lit(True)), "src_ip", "left").withColumn("member", F.coalesce("in_set", F.lit(False)))
    return rows.select("src_ip", "member", (~c("member") | c("maybe")).alias("no_false_negative"))


@query("topk_heavy_hitters", sql("SELECT w, src_ip, n FROM (SELECT w, src_ip, count(*) AS n, row_number() OVER (PARTITION BY w ORDER BY count(*) DESC, src_ip) AS k FROM packets GROUP BY w, src_ip) s WHERE k <= 10"))
def topk_heavy_hitters(spark, sf):
    o = Window.partitionBy("w").orderBy(F.desc("n"), "key")
    return K.key_counts(packets(spark, sf), "src_ip", DAY).withColumn("k", F.row_number().over(o)).where("k <= 10").select("w", c("key").alias("src_ip"), "n")


@query("heavy_hitter_count", sql("SELECT w, CAST(count(*) FILTER (WHERE n > 4) AS BIGINT) AS heavy FROM (SELECT w, src_ip, count(*) AS n FROM packets GROUP BY w, src_ip) s GROUP BY w"))
def heavy_hitter_count(spark, sf):
    return K.key_counts(packets(spark, sf), "src_ip", DAY).groupBy("w").agg(T.count_where(c("n") > 4).alias("heavy"))


@query("unique_ip_count", sql("SELECT f AS w, count(*) AS new_ips FROM (SELECT src_ip, min(w) AS f FROM packets GROUP BY src_ip) s GROUP BY f"))
def unique_ip_count(spark, sf):
    first = packets(spark, sf).groupBy("src_ip").agg(F.min("ts").alias("ts"))
    return first.groupBy(K.window_start(DAY).alias("w")).agg(F.count("*").alias("new_ips")).transform(K.named)


@query("top_url", sql("SELECT w, arg_max(path, (n, path)) AS path, CAST(max(n) AS BIGINT) AS n, round(max(n) / sum(n)::DOUBLE, 6) AS share FROM (SELECT w, left(split_part(payload, ' ', 2), 255) AS path, count(*) AS n FROM http_requests GROUP BY 1, 2) s GROUP BY w", "packets", "http_requests"))
def top_url(spark, sf):
    rows = http_requests(spark, sf).groupBy(K.window_start(DAY).alias("w"), T.request_path(c("payload")).alias("path")).agg(F.count("*").alias("n")).transform(K.named)
    return rows.groupBy("w").agg(F.max_by("path", F.struct("n", "path")).alias("path"), F.max("n").alias("n"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))


@query("entropy_src_ip", sql("SELECT w, round(entropy(src_ip), 6) AS entropy FROM packets GROUP BY w"))
def entropy_src_ip(spark, sf):
    return K.entropy(K.key_counts(packets(spark, sf), "src_ip", DAY), "entropy", "keys").select("w", "entropy")


@query("entropy_dst_port", sql("SELECT w, round(entropy(dst_port), 6) AS entropy FROM packets WHERE dst_port IS NOT NULL GROUP BY w"))
def entropy_dst_port(spark, sf):
    return K.entropy(K.key_counts(packets(spark, sf), "dst_port", DAY), "entropy", "keys").select("w", "entropy")
