"""Properties of operators on small tables: edge rows, sketches, frames, streams."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidegate.functions import quic
from tidegate.functions import traffic as T
from tidegate.operators import counters, joins, rules, runs, series, sketches
from tidegate.plans.files import require
from tidegate.sources import frames

PACKET = "pkt_id long, ts timestamp_ntz, src_ip long, dst_ip long, proto int, pkt_len int, src_port int, dst_port int, tcp_flags int, frag_off int"
AT = datetime(2024, 1, 1, 0, 0, 0, 500)


def packet(i, **more):
    row = {"pkt_id": i, "ts": AT, "src_ip": 168427780, "dst_ip": T.SERVER_IP, "proto": 6, "pkt_len": 60, "src_port": 1024, "dst_port": 80, "tcp_flags": 2, "frag_off": 0} | more
    return tuple(row.values())


def test_feature_row_edges(spark):
    rows = spark.createDataFrame([packet(1, proto=1, src_port=None, dst_port=None, tcp_flags=None), packet(2, proto=17, tcp_flags=None, pkt_len=0)], PACKET)
    (got,) = counters.feature_rows(rows).collect()
    assert got["tcp_ratio"] == 0 and got["syn_ratio"] == 0 and got["udp_ratio"] == 0.5 and got["entropy_src_ip"] == 0 and got["unique_dst_ports"] == 1
    assert counters.feature_rows(spark.createDataFrame([], PACKET)).collect() == []
    only_icmp = spark.createDataFrame([packet(1, proto=1, src_port=None, dst_port=None, tcp_flags=None)], PACKET)
    assert counters.feature_rows(only_icmp).first()["unique_dst_ports"] == 0


def test_flags_and_fragments(spark):
    rows = spark.createDataFrame([packet(1, tcp_flags=18, frag_off=0x2000), packet(2, tcp_flags=None, frag_off=0x4000), packet(3, tcp_flags=16, frag_off=7)], PACKET)
    got = rows.select(T.is_syn_ack(F.col("tcp_flags")), T.is_pure_ack(F.col("tcp_flags")), T.is_fragment(F.col("frag_off"))).collect()
    assert [tuple(r) for r in got] == [(True, False, True), (False, False, False), (False, True, True)]


@pytest.mark.parametrize("ip", [0, 1, 168427778, 4294967295])
def test_address_round_trip(spark, ip):
    assert spark.range(1).select(T.string_to_ip(T.ip_to_string(F.lit(ip).cast("long"))).alias("x")).first()["x"] == ip


def jenkins(data):
    h = 0
    for b in data:
        h = (h + b) & 0xFFFFFFFF
        h = (h + (h << 10)) & 0xFFFFFFFF
        h ^= h >> 6
    h = (h + (h << 3)) & 0xFFFFFFFF
    h ^= h >> 11
    return (h + (h << 15)) & 0xFFFFFFFF


@pytest.mark.parametrize("data", [(0, 0), (1, 2), (255, 255)])
def test_jenkins_wraps(spark, data):
    assert spark.range(1).select(T.jenkins_hash([F.lit(b).cast("long") for b in data]).alias("h")).first()["h"] == jenkins(data)


def test_frames_round_trip(spark):
    rows = spark.createDataFrame([packet(1), packet(2, proto=17, tcp_flags=None), packet(3, proto=1, src_port=None, dst_port=None, tcp_flags=None, frag_off=0x2001)], PACKET)
    names = [x for x in rows.columns if x not in ("ts", "pkt_len")]
    back = frames.decode_frames(frames.pack_frames(rows)).select(names).orderBy("pkt_id").collect()
    assert back == rows.select(names).orderBy("pkt_id").collect()
    short = spark.createDataFrame([(1, bytearray(b"\x00\x01"))], "pkt_id long, frame binary")
    assert frames.decode_frames(short).first()["src_ip"] is None


def test_sketches(spark):
    rows = spark.range(3000).select((F.col("id") % 200 * 7919 + 168427776).alias("ip"), "id")
    parts = [sketches.cms_build(rows.where(F.col("id") % 2 == i), "ip", 4, 512) for i in (0, 1)]
    whole = sketches.cms_build(rows, "ip", 4, 512)
    assert sketches.cms_merge(*parts).orderBy("row", "bucket").collect() == whole.select("row", "bucket", "cnt").orderBy("row", "bucket").collect()
    est = sketches.cms_query(whole, rows.select("ip").distinct(), "ip", 4, 512)
    assert est.where("estimate < 15").count() == 0
    n = sketches.hll_estimate(sketches.hll_registers(rows, "ip")).first()["estimate"]
    assert abs(n - 200) < 20
    member = sketches.bloom_member(rows, sketches.bloom_build(rows.where("ip % 2 = 0"), "ip"), "ip")
    assert member.where("ip % 2 = 0 AND NOT maybe").count() == 0 and member.where("ip % 2 = 1 AND maybe").count() < 5


def test_ranges_and_asof(spark):
    ips = spark.createDataFrame([(1, 168427777), (2, 168428033), (3, 5)], "pkt_id long, src_ip long")
    got = joins.join_networks(ips, joins.networks(spark)).orderBy("pkt_id").select("net_class").collect()
    assert [r[0] for r in got] == ["baseline", "attack", "other"]
    day = lambda d, h=0: datetime(2024, 1, d, h)
    events = spark.createDataFrame([("a", day(5)), ("a", day(1)), ("b", day(9)), ("a", day(8))], "k string, ts timestamp_ntz")
    marks = spark.createDataFrame([("a", day(3)), ("a", day(5)), ("a", day(5, 1)), ("b", day(10))], "k string, ts timestamp_ntz")
    got = {(r["k"], r["ts"]): r["mark_ts"] for r in joins.asof_before(events, marks, "k").collect()}
    assert got == {("a", day(5)): day(5), ("a", day(1)): None, ("b", day(9)): None, ("a", day(8)): day(5, 1)}


def test_split_lag_is_lag(spark):
    from pyspark.sql import Window

    rows = spark.range(400).select(F.col("id"), (F.col("id") * 37 % 101).alias("t"), (F.col("id") % 3).alias("k"))
    plain = rows.withColumn("p", F.lag("id").over(Window.partitionBy("k").orderBy("t", "id")))
    cut = series.split_lag(rows, "k", ("t", "id"), "id", F.floor(F.col("t") / 10), "p")
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, cut.select("id", "t", "k", "p").collect()), key=str)


def test_counter_goes_backwards(spark):
    rows = spark.createDataFrame([("r", 1, 10), ("r", 2, 4), ("r", 3, 9)], "run_id string, idx int, n long")
    assert [r["n_delta"] for r in series.counter_deltas(rows, ("n",)).orderBy("idx").collect()] == [10, 0, 5]


def test_rules_and_runs(spark):
    rows = spark.createDataFrame([("a", 5), ("b", None)], "w string, syn int")
    got = rules.evaluate(rows, [rules.above("syn", 3, "HIGH"), rules.above("syn", 4, "LOW", "second")]).orderBy("w").collect()
    assert (got[0]["alert_level"], got[0]["reasons"]) == ("HIGH", "SYN_FLOOD: 5; second: 5") and got[1]["alert_level"] == "NONE"
    snaps = spark.createDataFrame([("r", 1, 0.0, "HIGH")], "run_id string, idx int, attack_percent double, alert_level string")
    e = runs.efficacy(runs.confusion(snaps)).first()
    assert (e["fp"], e["precision"], e["recall"], e["f1"]) == (1, 0, 0, 0)


def test_required_columns(spark):
    with pytest.raises(ValueError, match="missing columns: b, c"):
        require(spark.range(1).withColumnRenamed("id", "a"), ("a", "c", "b"))


def test_quic_scan():
    assert quic.scan_acks(b"") == (0, None)
    assert quic.scan_acks(bytes([0x40]) + bytes(12) + b"\x02\x05\x02\x41\x00") == (2, 256)
    assert quic.scan_acks(bytes([0x40]) + bytes(12) + b"\x02\xc0\x01") == (0, None)
