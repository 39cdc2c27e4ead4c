"""First crossings inside windows, in batch and as a stream of several batches; gaps and dropped rows of streams."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tests.test_streams import SF, two_files
from tidegate.functions import quic as Q
from tidegate.functions import traffic as T
from tidegate.operators import quic as O
from tidegate.operators import ticks
from tidegate.sources.storage import scratch
from tidegate.sources.tables import packets, table
from tidegate.streaming import gaps, windows
from tidegate.streaming.ticks import early_alerts

c = F.col
ATTACK = lambda: (T.network_class(c("src_ip")) == "attack").cast("long")
FIRES = lambda s: (s["packets"] >= 10) & (s["attack"] * 100 > s["packets"] * 28)


def test_first_crossing_against_brute_force(spark):
    rng = random.Random(8)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(rng.choice("ab"), start + timedelta(microseconds=rng.randrange(20 * 10**6)), rng.randint(0, 9)) for _ in range(600)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v long")
    got = {(r["k"], r["win"]): (r["pane"], r["n"], r["v"]) for r in ticks.first_crossing(df, "5 seconds", "100 milliseconds", {"n": F.lit(1), "v": c("v")}, (c("n") >= 20) & (c("v") > 4.4 * c("n")), ("k",)).collect()}
    us = lambda t: (t - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
    want = {}
    for k in "ab":
        for win in range(us(start), us(start) + 20 * 10**6, 5 * 10**6):
            n = v = 0
            for pane in range(win, win + 5 * 10**6, 100_000):
                here = [x for q, t, x in rows if q == k and pane <= us(t) < pane + 100_000]
                n, v = n + len(here), v + sum(here)
                if here and n >= 20 and v > 4.4 * n:
                    want[k, win] = (pane, n, v)
                    break
    assert got == want and len(want) > 4
    with pytest.raises(ValueError):
        ticks.placed(df, "5 seconds", "300 milliseconds")


def test_early_alerts_over_two_batches(spark):
    """Late packets of the second batch move first panes; what is final equals the batch result; no state is left."""
    stream = two_files(spark, "event_id % 3 > 0 AND ts < TIMESTAMP '2024-01-20 00:00:00'", "event_id % 3 = 0 OR ts >= TIMESTAMP '2024-01-20 00:00:00'", delay="40 days")
    seen: list = []
    found = early_alerts(stream.rows.where(windows.on_time()), "1 day", "1 hour", {"packets": F.lit(1), "attack": ATTACK()}, FIRES)
    got = windows.run_available(stream, found, "test-early", "update", progress=seen).collect()
    condition = (c("packets") >= 10) & (c("attack") * 100 > c("packets") * 28)
    want = {r["win"]: (r["pane"], r["packets"], r["attack"]) for r in ticks.first_crossing(packets(spark, SF), "1 day", "1 hour", {"packets": F.lit(1), "attack": ATTACK()}, condition).collect()}
    final = {r["win"]: (r["pane"], r["packets"], r["attack"]) for r in got if r["final"] and r["pane"] is not None}
    assert final == want and sum(r["final"] for r in got) == 30
    # Alerts went out before their windows ended, some of them twice.
    early = [r["win"] for r in got if not r["final"] and r["pane"] is not None]
    assert set(want) <= set(early) and len(early) > len(set(early))
    assert seen[-1].stateOperators[0].numRowsTotal == 0 and windows.dropped_rows(seen) == 0


def test_gaps_over_batches(spark):
    stream = two_files(spark, "ts < TIMESTAMP '2024-01-15 00:00:00'", "ts >= TIMESTAMP '2024-01-15 00:00:00'")
    days = stream.rows.where(windows.on_time()).groupBy((c("src_ip") % 3).alias("sensor"), F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).where("n > 9")
    got = windows.run_available(stream, gaps.detection_gaps(days.select("sensor", F.unix_micros("w.start").alias("at_us"))), "test-gaps").collect()
    at = {}
    for r in packets(spark, SF).groupBy((c("src_ip") % 3).alias("sensor"), F.unix_micros(F.date_trunc("day", "ts").cast("timestamp")).alias("at")).count().where("count > 9").orderBy("at").collect():
        at.setdefault(r["sensor"], []).append(r["at"])
    assert {(r["sensor"], r["at_us"]): r["gap_us"] for r in got} == {(s, t): t - x if x else None for s, all_ in at.items() for x, t in zip([None, *all_], all_, strict=False)}


def test_dropped_rows_are_the_planted_ones(spark):
    """Late packets, among them one whose window is still open: only those behind the watermark go."""
    events = table(spark, SF, "events")
    path, late = scratch(spark, "test-late"), "event_id % 10 = 3"
    events.where(f"NOT ({late})").write.parquet(path)
    stream, seen = windows.stream_of(spark, path, events.schema), []
    rows = stream.rows.dropDuplicatesWithinWatermark(["pkt_id"]).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    done = windows.run_available(stream, rows, "test-late", feeds=[lambda: events.where(late).write.mode("append").parquet(path)], progress=seen)
    mark = events.where(f"NOT ({late})").agg(F.max("ts")).first()[0] - timedelta(hours=1)
    behind = events.where(late).where(c("ts") < F.lit(mark)).count()
    assert windows.dropped_rows(seen) == behind > 50
    assert done.where(windows.on_time("w.start")).agg(F.sum("n")).first()[0] == events.count() - behind


def quic_packet(ts, src, dst, sport, dport, payload, size=100):
    return (datetime(2024, 1, 1, 0, 0, 0, ts * 1000), src, dst, 17, size, sport, dport, bytearray(payload))


def test_clients_in_both_directions(spark):
    """Bytes from the server count for the client that they go to; frames that the server sends are not the client's."""
    attacker, client, server = 168428040, 168427790, T.SERVER_IP
    short, long = bytes([0x40]) + bytes(12), bytes([0xC0, 0, 0, 0, 1]) + bytes(15)
    ack = b"\x02\x05"
    rows = [quic_packet(1, attacker, server, 5000, 443, short + ack * 3), quic_packet(2, server, attacker, 443, 5000, short + ack, 900), quic_packet(3, client, server, 5001, 8443, long + ack), quic_packet(3, client, server, 5001, 443, bytes(20)), quic_packet(4, client, server, 5001, 53, short + ack), quic_packet(950, server, client, 443, 5001, short, 50)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, src_ip long, dst_ip long, proto int, pkt_len int, src_port int, dst_port int, payload binary")
    quic = O.quic_rows(df)
    by = {r["client"]: r for r in O.client_counters(quic).collect()}
    assert set(by) == {attacker, client}
    a, b = by[attacker], by[client]
    assert (a["packets"], a["acks"], a["acks_in"], a["bytes_in"], a["bytes_out"], a["attack"]) == (2, 4, 3, 100, 900, 1)
    assert (b["packets"], b["long"], b["short"], b["acks_in"], b["bytes_out"], b["attack"]) == (2, 1, 1, 1, 50, 0)
    (w,) = O.window_counters(O.client_counters(quic), heavy_acks=2).collect()
    assert (w["packets"], w["acks"], w["max_acks"], w["heavy_ackers"], w["ack_ips"], w["max_client_ratio"], w["out_in_ratio"]) == (4, 5, 3, 1, 2, 9.0, 4.75)
    (e,) = O.early_amplification(quic, O.QuicLimits(packets=2)).collect()
    assert (e["pane"] - e["win"], e["packets"], e["bytes_in"], e["bytes_out"], e["ratio"], e["margin"]) == (0, 3, 200, 900, 4.5, -1.5)
    assert O.early_amplification(quic).count() == 0  # too few packets for the detector's own limits
    assert Q.scan_acks(short + ack * 3) == (3, 5)
