"""Sources and sinks: each sink writes into the shared folder and what is read back is the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.functions import traffic as T
from tidegate.operators import counters as K
from tidegate.operators import rules as R
from tidegate.plans.counters import FEATURES, ratio_sql
from tidegate.plans.registry import query
from tidegate.sources import frames as N
from tidegate.sources.storage import scratch
from tidegate.sources.tables import packets, sql

c = F.col
DAY = "1 day"
PACKET = "pkt_id, src_ip, dst_ip, proto, src_port, dst_port, tcp_flags, frag_off"


@query("decode_frames", sql(f"SELECT {PACKET} FROM packets"))
def decode_frames(spark, sf):
    return N.decode_frames(N.pack_frames(packets(spark, sf))).select(*PACKET.split(", "))


@query("src_captures", sql("SELECT src_ip, proto, CAST(count(*) AS BIGINT) AS packets, CAST(sum(pkt_len) AS BIGINT) AS bytes FROM packets GROUP BY src_ip, proto"))
def src_captures(spark, sf):
    """Packets written as capture files and read back through the data source."""
    folder = scratch(spark, "captures")
    N.write_captures(N.pack_frames(packets(spark, sf)), folder).write.format("noop").mode("overwrite").save()
    rows = N.decode_frames(N.read_captures(spark, folder))
    return rows.groupBy("src_ip", "proto").agg(F.count("*").alias("packets"), F.sum("pkt_len").alias("bytes"))


LOG = "w string, pps double, gbps double, tcp long, udp long, icmp long, syn long, ack long, rst long, fin long, frag long"
LOG_SQL = "SELECT w, round(packets / 86400.0::DOUBLE, 6) AS pps, round(bytes * 8 / 1e9 / 86400, 9) AS gbps, tcp, udp, icmp, syn, ack, rst, fin, frag FROM counters"


def detection_log(spark, sf):
    rows = K.window_counters(packets(spark, sf), DAY).select("w", F.round(c("packets") / 86400.0, 6).alias("pps"), F.round(c("bytes") * 8 / 1e9 / 86400, 9).alias("gbps"), "tcp", "udp", "icmp", "syn", "ack", "rst", "fin", "frag")
    path = scratch(spark, "detection-log")
    rows.write.csv(path, header=True)
    return path


@query("sink_detection_log", sql(LOG_SQL, "counters"))
def sink_detection_log(spark, sf):
    return spark.read.schema(LOG).csv(detection_log(spark, sf), header=True)


@query("src_detection_log", sql("SELECT CAST(epoch(strptime(w, '%Y-%m-%d %H:%M:%S')) AS BIGINT) AS ts_s, tcp, udp FROM counters", "counters"))
def src_detection_log(spark, sf):
    rows = spark.read.schema(LOG).csv(detection_log(spark, sf), header=True)
    return rows.select(F.unix_timestamp("w", "yyyy-MM-dd HH:mm:ss").alias("ts_s"), "tcp", "udp")


def require(df, columns: tuple[str, ...]):
    """The frame itself, or an error that names the columns it lacks."""
    if lacking := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


@query("src_required_cols", sql("SELECT w, packets FROM counters", "counters"))
def src_required_cols(spark, sf):
    return require(K.window_counters(packets(spark, sf), DAY), ("w", "packets", "syn")).select("w", "packets")


def features_csv(spark, sf):
    rows = K.feature_rows(packets(spark, sf), DAY, 86400.0)
    path = scratch(spark, "features")
    rows.withColumn("month", F.left("w", F.lit(7))).write.partitionBy("month").csv(path, header=True)
    return path, rows.schema


@query("sink_ml_features", sql(FEATURES, "counters"))
def sink_ml_features(spark, sf):
    path, schema = features_csv(spark, sf)
    return spark.read.schema(schema.add("month", "string")).csv(path, header=True).drop("month")


@query("src_ml_features", sql(f"SELECT w, {ratio_sql('syn', 'tcp')} AS syn_ratio, {ratio_sql('frag', 'packets')} AS frag_ratio FROM counters", "counters"))
def src_ml_features(spark, sf):
    return sink_ml_features(spark, sf).select("w", "syn_ratio", "frag_ratio")


@query("sink_features_export", sql("SELECT w, CAST(syn AS BIGINT) AS syn, CAST(ack AS BIGINT) AS ack FROM counters", "counters"))
def sink_features_export(spark, sf):
    path = scratch(spark, "export")
    K.window_counters(packets(spark, sf), DAY).select("w", "syn", "ack").write.csv(path, header=True)
    return spark.read.schema("w string, syn long, ack long").csv(path, header=True)


@query("sink_alerts", sql("SELECT w, 'SYN_FLOOD' AS alert_type, 'CRITICAL' AS severity, concat('syn/tcp ', syn, '/', tcp) AS details FROM counters WHERE syn > 0.34 * tcp", "counters"))
def sink_alerts(spark, sf):
    rule = R.Rule("SYN_FLOOD", "CRITICAL", c("syn") > 0.34 * c("tcp"), F.concat(F.lit("syn/tcp "), c("syn"), F.lit("/"), c("tcp")))
    path = scratch(spark, "alerts")
    R.alerts(K.window_counters(packets(spark, sf), DAY), [rule]).write.csv(path, header=True)
    return spark.read.schema("w string, alert_type string, severity string, details string").csv(path, header=True)


@query("sink_distributions_json", sql("SELECT net AS name, count(DISTINCT pkt_len) AS sizes, CAST(sum(pkt_len) AS BIGINT) AS total FROM packets GROUP BY net"))
def sink_distributions_json(spark, sf):
    """Value counts of each class as JSON lines, read back."""
    path = scratch(spark, "distributions")
    packets(spark, sf).groupBy(T.network_class(c("src_ip")).alias("name"), "pkt_len").agg(F.count("*").alias("n")).write.json(path)
    rows = spark.read.schema("name string, pkt_len int, n long").json(path)
    return rows.groupBy("name").agg(F.count("*").alias("sizes"), F.sum(c("pkt_len") * c("n")).alias("total"))


@query("dataset_manifest", sql("SELECT name, sha256(line || chr(10)) AS sha256, CAST(strlen(line) + 1 AS BIGINT) AS bytes, packets FROM (SELECT net AS name, count(*) AS packets, concat_ws(',', count(*), sum(pkt_len), count(DISTINCT src_ip)) AS line FROM packets GROUP BY net) s"))
def dataset_manifest(spark, sf):
    """The manifest of a dataset (here a file of totals for each network): name, SHA-256, bytes and packets of each file, written as JSON and read back."""
    path, out = scratch(spark, "dataset"), scratch(spark, "manifest")
    totals = packets(spark, sf).groupBy(T.network_class(c("src_ip")).alias("name")).agg(F.count("*").alias("n"), F.sum("pkt_len").alias("b"), F.count_distinct("src_ip").alias("s"))
    totals.select("name", F.concat_ws(",", "n", "b", "s").alias("line")).repartition(1).write.partitionBy("name").text(path, lineSep="\n")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("name", F.sha2("content", 256).alias("sha256"), c("length").alias("bytes"), F.split(c("content").cast("string"), ",")[0].cast("long").alias("packets"))
    files.write.json(out)
    return spark.read.schema("name string, sha256 string, bytes long, packets long").json(out)
